"""A cleaning pipeline for training corpora: five of the corpus operators, one after the other.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of
`documents`.  Each is written as Parquet and reread before the next.

* quality rules: documents that the rules reject go.
* line dedup: later copies of runs of lines are cut out of the texts (n_chars follows); documents of which
  nothing is left go.
* n-gram Jaccard join: of each component of near duplicates (five-word shingles, similarity 0.8) the
  document with the least doc_id stays; documents without words stay.
* benchmark decontamination: documents into which a benchmark item leaked go.
* best-fit packing: the rest in sequences of 2048 tokens, a row for each piece.

Null doc_ids, null texts, repeated rows and very long texts are treated as the operators say.  Extra columns are carried
by all stages but the last, whatever their names (names that differ only in case from `doc_id`, `text` or `lang`
cannot stand beside them in one of Spark's tables); an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontamination, line_dedup, ngram_join, packing, quality
from tessella.llm.common import discard, materialize, open_accounts, read_table, sized, unused

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80

#: SQL can't express the model of the quality rules, nor the packing.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


_written: list[str] = []


def stage(f: Stage) -> Stage:
    """Each stage's result is written before the next stage begins, so the next one deletes what the stages before it
    wrote on their way, but for what its own documents are read from."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if f is _first:
            _written.clear()
        read = docs.inputFiles() if _written else []
        gone = [p for p in _written if not any(p.rsplit("/", 1)[-1] in x for x in read)]
        discard(spark, *gone)
        _written[:] = [p for p in _written if p not in gone]
        open_accounts().append(_written)
        try:
            return f(spark, docs, sf_dir)
        finally:
            open_accounts().pop()

    return run_stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A verdict depends on text and language alone, so it finds its documents by a hash of the two."""
    key = F.unhex(F.md5(F.concat_ws("\x00", F.col("text").isNull().cast("string"), F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")))))
    name = unused(docs, "rejected_key")
    rejected = quality.judge(docs.select(key.alias("key"), "text", "lang"), row="key").where(~F.col("kept")).select(F.col("row").alias(name)).distinct()
    return docs.join(sized(rejected, "rejected"), key == F.col(name), "left_anti")


def deduplicated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    left = out.where((F.col("n_removed") == 0) | line_dedup.visible(F.col("kept")))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*[(new[c] if c in new else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row is known by its id and its text's hash; of rows that have both in common one stays, if any does."""
    name = unused(docs, "text_hash")
    placed = ngram_join.join(docs, SHINGLE_WORDS, SIMILARITY_PERCENT).where("n_shingles > 0").select("group", "doc_id", "th", "row")
    keys = placed.groupBy("group", "doc_id", "th").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("row"))
    best = keys.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")).select("group", F.col("best.row").alias("stays"))
    judged, _ = materialize(keys.join(best, "group").select("doc_id", "th", "rows", (F.col("row") == F.col("stays")).alias("stays")), "pipeline-groups")
    hashed = docs.withColumn(name, F.xxhash64("text"))

    def among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return rows.join(ids, hashed["doc_id"].eqNullSafe(ids["doc_id"]) & (hashed[name] == ids["th"]), how)

    rest = among(hashed, sized(judged.where("not stays").select("doc_id", "th"), "pipeline-goes"), "left_anti")
    again = sized(judged.where("stays and rows > 1").select("doc_id", "th"), "pipeline-again")
    once = among(hashed, again, "left_semi").dropDuplicates(["doc_id", name])
    return among(rest, again, "left_anti").unionByName(once).drop(name)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


_first = quality_rules
STAGES = [
    ("quality rules", stage(quality_rules)),
    ("line dedup", stage(deduplicated_lines)),
    ("n-gram jaccard join", stage(one_of_each_group)),
    ("benchmark decontamination", stage(decontaminated)),
    ("best-fit packing", stage(packed)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        out, path = materialize(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        _written.append(path)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
