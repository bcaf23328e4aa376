"""Queries over logs, events and stored tables: rollups, ranks, windows, streaks, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog.base import Query, table
from tessella.operators.shared import shared_dir
from tessella.operators import rollups, storage
from tessella.sources import logs
from tessella.streaming import streams

AGENTS = ("Mozilla/5.0 (compatible; Googlebot/2.1)", "GPTBot/1.1", "Mozilla/5.0 (compatible; bingbot/2.0)", "Mozilla/5.0 (Windows NT 10.0) Safari/537.36", "AhrefsBot/7.0")


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events written as lines of a Combined log."""
    e = table(spark, d, "events")
    agent = F.element_at(F.array(*map(F.lit, AGENTS)), (F.col("user_id") % 5 + 1).cast("int"))
    time = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    line = F.concat(F.lit("10.0.0."), (F.col("user_id") % 200).cast("string"), F.lit(" - - ["), time, F.lit(' +0000] "GET /'), F.col("event_type"), F.lit("/"), (F.col("event_id") % 40).cast("string"), F.lit(' HTTP/1.1" '), F.when(F.col("event_type") == "error", "500").otherwise("200"), F.lit(" "), (F.col("event_id") % 1000).cast("string"), F.lit(' "-" "'), agent, F.lit('"'))
    return e.select(line.alias("value"))


LOGS = """
logs AS (
  SELECT '10.0.0.' || CAST(user_id % 200 AS VARCHAR) AS ip, ts, '/' || event_type || '/' || CAST(event_id % 40 AS VARCHAR) AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, event_id % 1000 AS bytes,
         CASE user_id % 5 WHEN 0 THEN 'Googlebot' WHEN 1 THEN 'GPTBot (OpenAI)' WHEN 2 THEN 'Bingbot' WHEN 4 THEN 'AhrefsBot' END AS bot, CASE user_id % 5 WHEN 0 THEN 'googlebot' WHEN 1 THEN 'ai' WHEN 2 THEN 'bingbot' WHEN 4 THEN 'seo-tool' ELSE 'other' END AS family, event_type
  FROM events)"""


def bot_hits(spark: SparkSession, d: str) -> DataFrame:
    return logs.rollup(logs.parsed(log_lines(spark, d)))["by_bot"].select("family", "bot", "hits", "bytes", "ips")


def section_hits(spark: SparkSession, d: str) -> DataFrame:
    r = logs.rollup(logs.parsed(log_lines(spark, d)))
    return r["by_section"].select("family", F.col("section").alias("what"), "hits").unionByName(r["by_status"].select("family", F.col("status_class").alias("what"), "hits")).unionByName(r["daily"].select("family", F.col("day").cast("string").alias("what"), "hits"))


SECTION_HITS = f"""
WITH {LOGS}
SELECT family, '/' || event_type AS what, count(*) AS hits FROM logs GROUP BY 1, 2
UNION ALL SELECT family, CASE WHEN status = 500 THEN '5xx' ELSE '2xx' END, count(*) FROM logs GROUP BY 1, 2
UNION ALL SELECT family, CAST(CAST(ts AS DATE) AS VARCHAR), count(*) FROM logs GROUP BY 1, 2
"""


def top_paths(spark: SparkSession, d: str) -> DataFrame:
    return logs.top_paths(logs.parsed(log_lines(spark, d)), 5).select("family", "path", "hits", F.col("rank").cast("bigint").alias("rank"))


TOP_PATHS = f"""
WITH {LOGS}, n AS (SELECT family, path, count(*) AS hits FROM logs GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY hits DESC, path) AS rank FROM n)
SELECT family, path, hits, rank FROM r WHERE rank <= 5
"""


def retention(spark: SparkSession, d: str) -> DataFrame:
    """Orders as scans of a customer's site: which may go when two of each status are kept."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("host"), F.col("o_orderstatus").alias("config"), F.col("o_orderdate").alias("finished"), F.col("o_orderkey").alias("uuid"), (F.col("o_orderkey") % 10 == 0).alias("pinned"))
    return rollups.retained(o, 2).select("uuid", "prune")


RETENTION = """
SELECT o_orderkey AS uuid, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) > 2 AND o_orderkey % 10 <> 0 AS prune FROM orders
"""


def streaks(spark: SparkSession, d: str) -> DataFrame:
    return rollups.streaks(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error")


STREAKS = """
WITH m AS (SELECT user_id, event_id, event_type = 'error' AS bad FROM events), i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM m),
r AS (SELECT user_id, island, count(*) FILTER (bad) AS n, max(event_id) AS last FROM i GROUP BY 1, 2)
SELECT user_id, max(n) AS streak, max_by(n, last) AS current FROM r GROUP BY 1
"""


def outliers(spark: SparkSession, d: str) -> DataFrame:
    return rollups.outliers(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", "n_chars")


OUTLIERS = """
WITH s AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.5) AS m, quantile_cont(n_chars, 0.75) AS b FROM documents)
SELECT doc_id, n_chars FROM documents, s WHERE b - a >= 0.1 * m AND n_chars > b + 1.5 * (b - a)
"""


def value_groups(spark: SparkSession, d: str) -> DataFrame:
    return rollups.value_groups(table(spark, d, "customer"), F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")), "c_custkey").select("value", "n", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


VALUE_GROUPS = "SELECT c_mktsegment || '/' || CAST(c_nationkey AS VARCHAR) AS value, count(*) AS n, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS members FROM customer GROUP BY 1 HAVING count(*) > 1"


def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.when(F.expr("o_orderkey % 6 <> 0"), F.col("o_totalprice").cast("string")).alias("price"), F.when(F.expr("o_orderkey % 4 = 0"), "x").otherwise(F.col("o_custkey").cast("string")).alias("customer"), F.lit(None).cast("string").alias("note"), F.col("o_orderstatus").alias("status"))
    return rollups.field_coverage(o, {"price": F.col("price").try_cast("double").isNotNull(), "customer": F.col("customer").try_cast("bigint").isNotNull(), "note": F.lit(True), "status": F.lit(True)})


FIELD_COVERAGE = """
SELECT 'price' AS field, count(*) FILTER (o_orderkey % 6 <> 0) AS present, count(*) FILTER (o_orderkey % 6 = 0) AS missing, CAST(0 AS BIGINT) AS invalid, 'partial' AS state FROM orders
UNION ALL SELECT 'customer', count(*) FILTER (o_orderkey % 4 <> 0), 0, count(*) FILTER (o_orderkey % 4 = 0), 'partial' FROM orders
UNION ALL SELECT 'note', 0, count(*), 0, 'unavailable' FROM orders
UNION ALL SELECT 'status', count(*), 0, 0, 'complete' FROM orders
"""


def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    r = docs.select(F.when(F.expr("doc_id % 5 = 0"), "omitted").otherwise("retained").alias("body_state"), F.when(F.expr("doc_id % 5 = 0"), "oversized").alias("body_reason"), F.sha2("text", 256).alias("body_sha256"))
    return storage.corpus_summary(r)


def routes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return storage.rendered_routes(p.where("page_id % 3 <> 0").select("url", F.lit(True).alias("complete")), p.where("page_id % 4 <> 0").select("url", (F.col("page_id") != 1).alias("complete"))).groupBy("relation").agg(F.count(F.lit(1)).alias("urls"))


ROUTES = """
WITH s AS (SELECT DISTINCT url FROM pages WHERE page_id % 3 <> 0), r AS (SELECT DISTINCT url FROM pages WHERE page_id % 4 <> 0)
SELECT CASE WHEN s.url IS NOT NULL AND r.url IS NOT NULL THEN 'both' WHEN s.url IS NOT NULL THEN 'unknown' ELSE 'rendered_only' END AS relation, count(*) AS urls FROM s FULL OUTER JOIN r ON s.url = r.url GROUP BY 1
"""


def next_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of a table is the feature: the hundred orders after a key, and rows 20 to 30 by price."""
    o = table(spark, d, "orders")
    return rollups.keyset_page(o, "o_orderkey", 500, 100).select("o_orderkey", F.lit("keyset").alias("way")).unionByName(rollups.table_page(o, ["o_totalprice", "o_orderkey"], 20, 10).select("o_orderkey", F.lit("offset").alias("way")))


NEXT_PAGE = """
SELECT o_orderkey, 'keyset' AS way FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100)
UNION ALL SELECT o_orderkey, 'offset' FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 20)
"""


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.windowed(table(spark, d, "events"), "ts", ["event_type"], "6 hours").select("event_type", F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n")


EVENT_WINDOWS = "SELECT event_type, strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H') AS start, count(*) AS n FROM events GROUP BY 1, 2"


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(table(spark, d, "events"), "ts", ["user_id"], "30 minutes").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k
"""


def streamed_days(spark: SparkSession, d: str) -> DataFrame:
    """The daily counts of a stream over what is there now; its rows are those of the batch."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/event*.parquet")
    counted = events.groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


QUERIES = (
    Query("bot_hits", bot_hits, f"WITH {LOGS} SELECT family, bot, count(*) AS hits, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT ip) AS ips FROM logs WHERE bot IS NOT NULL GROUP BY 1, 2"),
    Query("section_hits", section_hits, SECTION_HITS),
    Query("top_paths", top_paths, TOP_PATHS),
    Query("scan_retention", retention, RETENTION),
    Query("failure_streaks", streaks, STREAKS),
    Query("size_outliers", outliers, OUTLIERS),
    Query("value_groups", value_groups, VALUE_GROUPS),
    Query("field_coverage", field_coverage, FIELD_COVERAGE),
    Query("corpus_summary", corpus_summary, "SELECT CASE WHEN doc_id % 5 = 0 THEN 'omitted' ELSE 'retained' END AS body_state, CASE WHEN doc_id % 5 = 0 THEN 'oversized' ELSE '' END AS body_reason, count(*) AS responses, count(DISTINCT text) AS bodies FROM documents GROUP BY 1, 2"),
    Query("rendered_routes", routes, ROUTES),
    Query("table_pages", next_page, NEXT_PAGE),
    Query("event_windows", event_windows, EVENT_WINDOWS),
    Query("event_sessions", sessions, SESSIONS),
    Query("streamed_days", streamed_days, "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2"),
)
