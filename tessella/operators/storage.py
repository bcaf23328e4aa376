"""Scans kept as folders of tables, and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of a scan and the columns that must be there; the later ones may be absent.
TABLES = {
    "scan": ("scan_id", "host", "started", "finished", "partial", "config"), "urls": ("url_id", "url"), "bodies": ("sha256", "content"), "responses": ("response_id", "url_id", "status_code", "body_sha256", "body_state", "body_reason"),
    "documents": ("document_id", "response_id", "representation"), "pages": ("url_id", "url", "status_code"), "links": ("seq", "source", "destination"), "forms": ("page", "method", "action"), "decisions": ("url", "decision", "reason"),
    "frontier": ("url", "state"), "context_items": ("kind", "key", "payload", "completeness", "reason"), "audit": ("sha256", "document"),
}
LATER = ("retry_attempts", "retry_transitions", "resource_graph_occurrences", "resource_graph_fetches", "discovery_occurrences", "discovery_ledger_coverage", "response_transport_meta", "scan_events", "scan_event_meta")
REQUIRED = ("scan", "pages")
BODY_STATES = ("retained", "omitted", "failed", "none")


class Scan:
    """A scan's tables, opened for reading; a missing column or table that must be there is an error."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.names = frozenset(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
        if lost := [t for t in REQUIRED if t not in self.names]:
            raise FileNotFoundError(f"{path} lacks {', '.join(lost)}")
        if unknown := self.names - TABLES.keys() - set(LATER):
            raise ValueError(f"{path} has unknown tables: {', '.join(sorted(unknown))}")

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}")
        if lost := [c for c in TABLES.get(name, ()) if c not in df.columns]:
            raise ValueError(f"{name} lacks {', '.join(lost)}")
        return df


def write_scan(tables: dict[str, DataFrame], path: str) -> None:
    """Writes under a name of its own and moves it in place when all is there, so that no reader sees a part."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}.part/{name}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(hadoop.Path(f"{path}.part"), hadoop.Path(path)):
        raise OSError(f"{path} could not be put in place")


def link_stream(links: DataFrame) -> DataFrame:
    return links.orderBy("seq")


def corpus_summary(responses: DataFrame) -> DataFrame:
    """body_state, body_reason, responses, bodies."""
    return responses.groupBy("body_state", F.coalesce("body_reason", F.lit("")).alias("body_reason")).agg(F.count(F.lit(1)).alias("responses"), F.countDistinct("body_sha256").alias("bodies"))


def render_summary(documents: DataFrame) -> DataFrame:
    return documents.groupBy("representation").agg(F.count(F.lit(1)).alias("documents"))


def event_timeline(events: DataFrame, after: int = -1, limit: int = 100) -> DataFrame:
    return events.where(F.col("sequence") > after).orderBy("sequence").limit(limit)


def bounded_events(events: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The first `cap` events by sequence, and one row: captured, dropped."""
    kept = events.orderBy("sequence").limit(cap)
    n = events.agg(F.count(F.lit(1)).alias("n"))
    return kept, n.select(F.least(F.col("n"), F.lit(cap)).alias("captured"), F.greatest(F.col("n") - cap, F.lit(0)).alias("dropped"))


def rendered_routes(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """url, relation (both, static_only, rendered_only, unknown): url, complete on both sides; an incomplete side can't say that it lacks a route."""
    a = static.groupBy("url").agg(F.bool_and("complete").alias("s"))
    b = rendered.groupBy("url").agg(F.bool_and("complete").alias("r"))
    sides = static.agg(F.coalesce(F.bool_and("complete"), F.lit(False)).alias("all_s")).crossJoin(rendered.agg(F.coalesce(F.bool_and("complete"), F.lit(False)).alias("all_r")))
    both = a.join(b, "url", "full_outer").crossJoin(F.broadcast(sides))
    return both.select("url", F.when(F.col("s").isNotNull() & F.col("r").isNotNull(), "both").when(F.col("s").isNotNull(), F.when(F.col("all_r"), "static_only").otherwise("unknown")).otherwise(F.when(F.col("all_s"), "rendered_only").otherwise("unknown")).alias("relation"))


def retained_corpus(responses: DataFrame, documents: DataFrame, bodies: DataFrame) -> DataFrame:
    """document_id, representation, html of the documents whose body was kept."""
    return documents.join(responses.where("body_state = 'retained'"), "response_id").join(bodies, F.col("body_sha256") == F.col("sha256")).select("document_id", "representation", F.try_validate_utf8(F.decode("content", "UTF-8")).alias("html"))


def lineage_errors(scan: Scan) -> DataFrame:
    """what, rows: references that lead nowhere, and values that aren't allowed."""
    checks = []
    if {"responses", "urls"} <= scan.names:
        checks.append(("responses.url_id", scan.table("responses").join(scan.table("urls"), "url_id", "left_anti")))
    if {"documents", "responses"} <= scan.names:
        checks.append(("documents.response_id", scan.table("documents").join(scan.table("responses"), "response_id", "left_anti")))
    if {"responses", "bodies"} <= scan.names:
        r = scan.table("responses")
        checks += [("responses.body_sha256", r.where("body_state = 'retained'").join(scan.table("bodies"), r.body_sha256 == F.col("sha256"), "left_anti")), ("responses.body_state", r.where(~F.col("body_state").isin(*BODY_STATES)))]
    if "bodies" in scan.names:
        checks.append(("bodies.sha256", scan.table("bodies").where(F.sha2("content", 256) != F.col("sha256"))))
    out = scan.spark.createDataFrame([], "what string, rows bigint")
    for what, df in checks:
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(what).alias("what"), "rows"))
    return out.where("rows > 0")


def context_of(items: DataFrame, kind: str, schema: str) -> DataFrame:
    """The items of one kind with their payload read; an incomplete one keeps its reason."""
    return items.where(F.col("kind") == kind).select("key", F.from_json("payload", schema).alias("payload"), "completeness", "reason")


def scan_status(scan: Scan) -> DataFrame:
    """table, rows of every table that is there."""
    out = scan.spark.createDataFrame([], "table string, rows bigint")
    for name in sorted(scan.names):
        out = out.unionByName(scan.table(name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows"))
    return out
