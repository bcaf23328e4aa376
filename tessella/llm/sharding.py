"""Sharding by extendible hashing, with DataFrame functions only.

The directory is indexed by leading bits of a hash of the document's key.  A bucket over the byte limit
splits on one bit more, and only such a bucket, until every shard fits; a directory entry points to the
bucket of the fewest bits that does.  Sums over cells of many bits give all the splits of several bits in
one pass; only cells that are still too large are looked at again with more bits.

Rows with one key (or a null key) can't be told apart by its hash.  Where its 60 bits are used up, bits of
a number that each row has alone follow, so one key may hold any share of the rows.  A document that
exceeds the limit by itself gets a shard of its own, flagged oversize.  Null text has 0 bytes.  An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import materialize, read_table, with_columns_kept

BITS = 60
#: Bits that a pass looks ahead.
STEP = 8
#: Of UTF-8 text in a shard.
LIMIT_BYTES = 1 << 20


def hash_bits(value: Column) -> Column:
    """The leading 60 bits of the md5 of a value's text, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(bits: Column, more: Column, depth: int) -> tuple[Column, Column]:
    """The first `depth` bits of a key's hash and, beyond its 60, of the row's own hash, as two numbers."""
    first = min(depth, BITS)
    return F.shiftright(bits, BITS - first), F.shiftright(more, BITS - (depth - first))


def ancestors(low: int, high: int) -> Column:
    """For a cell of `high` bits: (depth, a, b) for each depth from low to high."""
    one = []
    for d in range(low, high + 1):
        a, b = F.col("a"), F.col("b")
        if high <= BITS:
            a = F.shiftright(a, high - d)
        elif d <= BITS:
            a, b = F.shiftright(a, BITS - d), F.lit(0).cast("long")
        else:
            b = F.shiftright(b, high - d)
        one.append(F.struct(F.lit(d).alias("depth"), a.alias("pa"), b.alias("pb")))
    return F.explode(F.array(*one))


def assign(docs: DataFrame, limit: int = LIMIT_BYTES, whole_rows: bool = False) -> DataFrame:
    """doc_id, n_bytes, shard_id ('depth:bits'), depth, shard_bytes, shard_docs, oversize; and the row itself if asked for."""
    carried = ["row"] if whole_rows else []
    kept = with_columns_kept(docs, "doc_id", "text")
    if whole_rows:
        kept = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed, _ = materialize(
        kept.select(*carried, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(F.col("doc_id")).alias("bits"), hash_bits(F.monotonically_increasing_id()).alias("more")),
        "sharding-keys",
    )
    total = keyed.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + 3)
    found, rows = [], keyed
    while True:
        a, b = prefix(F.col("bits"), F.col("more"), high)
        celled = rows.withColumns({"a": a, "b": b})
        cells = celled.groupBy("a", "b").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        cells, _ = materialize(cells, "sharding-cells")
        levels = cells.select("a", "b", "bytes", "n", ancestors(low, high).alias("x")).select("a", "b", "bytes", "n", "x.*")
        sums = levels.groupBy("depth", "pa", "pb").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)
        pointed = levels.select("a", "b", "depth", "pa", "pb").join(sums.where(fits), ["depth", "pa", "pb"])
        directory = pointed.groupBy("a", "b").agg(F.min(F.struct("depth", "pa", "pb", "shard_bytes", "shard_docs")).alias("leaf"))
        found.append(celled.join(directory, ["a", "b"]).select(*carried, "doc_id", "n_bytes", "leaf.*"))
        over = cells.where((F.col("bytes") > limit) & (F.col("n") > 1)).select("a", "b")
        if high >= 2 * BITS or over.isEmpty():
            break
        rows, _ = materialize(celled.join(over, ["a", "b"], "left_semi").drop("a", "b"), "sharding-rest")
        low, high = high + 1, min(high + STEP, BITS if high < BITS else 2 * BITS)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    bits = F.when(F.col("depth") <= BITS, F.lpad(F.bin("pa"), F.col("depth"), "0")).otherwise(F.concat(F.lpad(F.bin("pa"), F.lit(BITS), "0"), F.lpad(F.bin("pb"), F.col("depth") - BITS, "0")))
    return out.select(*carried, "doc_id", "n_bytes", F.concat_ws(":", F.col("depth").cast("string"), F.when(F.col("depth") == 0, "").otherwise(bits)).alias("shard_id"), "depth", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversize"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Writes the documents with a folder for each shard."""
    assign(docs, limit, whole_rows=True).select("shard_id", "row.*").repartition("shard_id").write.partitionBy("shard_id").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "documents"))


#: The same by definition: a document's shard is the shortest hash prefix whose documents fit the limit.
OP5_SQL = f"""
WITH keyed AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS bits
  FROM documents),
levels AS (SELECT CAST(range AS INTEGER) AS depth FROM range(0, 25)),
placed AS (SELECT k.doc_id, k.n_bytes, l.depth, k.bits >> ({BITS} - l.depth) AS pa FROM keyed k CROSS JOIN levels l),
sums AS (SELECT depth, pa, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM placed GROUP BY depth, pa),
fits AS (
  SELECT p.doc_id, p.n_bytes, p.depth, p.pa, s.shard_bytes, s.shard_docs,
         row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS k
  FROM placed p JOIN sums s ON p.depth = s.depth AND p.pa = s.pa
  WHERE s.shard_bytes <= {LIMIT_BYTES} OR s.shard_docs = 1)
SELECT doc_id, n_bytes,
       CAST(depth AS VARCHAR) || ':' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(pa), depth, '0') END AS shard_id,
       depth, shard_bytes, shard_docs, shard_bytes > {LIMIT_BYTES} AS oversize
FROM fits WHERE k = 1
"""
