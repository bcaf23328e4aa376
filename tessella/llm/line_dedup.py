"""Line dedup with a suffix array over line ids, with DataFrame functions only.

Every document is a sequence of line ids (lines without a visible character are passed over).  Prefix
doubling ranks its suffixes by their first 1, 2, 4, ... lines: the rank after a step is that of the pair
(rank of the suffix, rank of the suffix that many lines on), or 0 in place of the second where the document
ends.  Suffixes of one rank form an interval of the suffix array whose longest common prefix is known: that
many lines, or all lines to the document's end.  A suffix whose rank no other has is in its final place and
goes no further, so that a step handles repeated runs only.  In the deepest interval that holds a suffix
together with an earlier one (by doc_id, then place), its lines are a later copy; copies that touch or
overlap are one maximal run, and its lines are deleted.

Ranks come from sorting distinct pairs over all tasks; groups are counted before the shuffle, and a line
that holds a third of all rows is one row among the ranked pairs.

A least length that is no power of two is ranked by itself, from the pair of ranks whose lines overlap.

Runs of fewer than MIN_LINES lines stay, unless it is one line of LONG_LINE characters or more.  Very long texts are
lines like any others.  Null text stays null; an empty one stays empty.  Repeated rows
are copies of each other like any others.  Extra columns are carried by dedup_lines; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import build, materialize, read_table, with_columns_kept

#: Consecutive lines that a copy must have to be deleted.
MIN_LINES = 2
#: Characters from which a line is deleted as a later copy by itself: a passage of some fifty words.
LONG_LINE = 300
#: Bytes of all documents' cuts that may be sent to every task.
SENT_BYTES = 16 << 20


def visible(line: Column) -> Column:
    return line.rlike(r"[^\s]")


def line_ids(rows: DataFrame) -> DataFrame:
    """rows: row, doc_id, text; a row for each visible line: row, doc_id, pos, line_no, n (visible lines of the document), id, long."""
    own = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda x: visible(x["line"]))
    return rows.select("row", "doc_id", own.alias("own")).select("row", "doc_id", F.size("own").alias("n"), F.posexplode("own").alias("pos", "x")).select("row", "doc_id", "pos", "x.line_no", "n", F.unhex(F.md5("x.line")).alias("id"), (F.length("x.line") >= LONG_LINE).alias("long"))


def place() -> Column:
    return F.struct("doc_id", "row", "pos")


def ranked(active: DataFrame, keys: list[str], length: Column, *also: str) -> DataFrame:
    """The suffixes that share their keys with another: with rank by the keys' order, the length of their common prefix, and whether an earlier one has it."""
    groups = active.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min(place()).alias("first")).where("size > 1")
    groups, _ = materialize(groups.orderBy(*keys).withColumn("new", F.monotonically_increasing_id() + 1).drop("size"), "line-groups")
    out = active.join(groups, keys).select("row", "doc_id", "pos", "n", F.col("new").alias("rank"), length.cast("int").alias("length"), (place() != F.col("first")).alias("later"), *also)
    return materialize(out, "line-ranks")[0]


def suffix_intervals(lines: DataFrame, min_lines: int) -> DataFrame:
    """row, pos, length, long: for each suffix with an earlier copy, the lines in common in the deepest interval that holds
    both, and whether its first line is a long one; min_lines is a depth besides the powers of two."""
    active = ranked(lines.select("row", "doc_id", "pos", "n", "id", "long"), ["id"], F.lit(1), "long")
    steps, reach = [active], 1
    while not active.where(F.col("n") - F.col("pos") > reach).isEmpty():
        along = Window.partitionBy("row").orderBy("pos")
        if reach < min_lines < 2 * reach:  # the first min_lines lines are the first and the last `reach` of them
            rest = min_lines - reach
            both = active.withColumn("next", F.first("rank").over(along.rangeBetween(rest, rest))).where((F.col("pos") + min_lines <= F.col("n")) & F.col("next").isNotNull())
            steps.append(ranked(both.withColumnRenamed("rank", "own"), ["own", "next"], F.lit(min_lines)))
        ahead = F.first("rank").over(along.rangeBetween(reach, reach))
        paired = active.withColumn("next", F.when(F.col("pos") + reach >= F.col("n"), F.lit(0).cast("long")).otherwise(ahead)).where(F.col("next").isNotNull())
        reach *= 2
        active = ranked(paired.withColumnRenamed("rank", "own"), ["own", "next"], F.least(F.lit(reach), F.col("n") - F.col("pos")))
        steps.append(active)
    found = steps[0].where("later")
    for step in steps[1:]:
        found = found.unionByName(step.where("later"), allowMissingColumns=True)
    return found.groupBy("row", "pos").agg(F.max("length").alias("length"), F.max("long").alias("long"))


def copied_runs(lines: DataFrame, min_lines: int) -> DataFrame:
    """row, run, low, high: maximal runs of visible lines [low, high) that are later copies."""
    before = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("pos")
    marked = suffix_intervals(lines, min_lines).where((F.col("length") >= min_lines) | F.col("long")).withColumn("reach", F.max(F.col("pos") + F.col("length")).over(before))
    numbered = marked.withColumn("run", F.sum(F.when(F.col("reach").isNull() | (F.col("pos") > F.col("reach")), 1).otherwise(0)).over(upto))
    return numbered.groupBy("row", "run").agg(F.min("pos").alias("low"), F.max(F.col("pos") + F.col("length")).alias("high"))


def cuts_of(texts: DataFrame, min_lines: int) -> DataFrame:
    """texts: row, doc_id, text; row, cuts (ranges of line numbers to delete), n_runs, n_removed."""
    lines, _ = materialize(line_ids(texts), "lines")
    runs = copied_runs(lines, min_lines)
    deleted = runs.select("row", "run", F.explode(F.sequence("low", F.col("high") - 1)).alias("pos")).join(lines.select("row", "pos", "line_no"), ["row", "pos"])
    gap = F.col("line_no") - F.row_number().over(Window.partitionBy("row").orderBy("line_no"))
    ranges = deleted.withColumn("gap", gap).groupBy("row", "gap").agg(F.min("line_no").alias("low"), F.max("line_no").alias("high"), F.max("run").alias("run_high"))
    return ranges.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("cuts"), F.max("run_high").alias("n_runs"), F.sum(F.col("high") - F.col("low") + 1).alias("n_removed"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc: the row as it was; kept: its text without later copies; n_lines, n_removed, n_runs."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = with_columns_kept(docs, "doc_id", "text")
    whole = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*columns).alias("doc")) if {"doc_id", "text"} <= set(docs.columns) else kept.select(F.monotonically_increasing_id().alias("row"), F.struct("doc_id", "text").alias("doc"))
    rows, _ = materialize(whole, "line-documents")
    cuts = build(docs.sparkSession, "line-cuts", lambda: cuts_of(rows.select("row", "doc.doc_id", "doc.text"), min_lines))
    # Few cuts go to the documents; only many are worth moving the documents for.
    size = cuts.agg(F.sum(F.size("cuts") * 8 + 32)).first()[0] or 0
    cuts = F.broadcast(cuts) if size <= SENT_BYTES else cuts.hint("merge")
    text_lines = F.split("doc.text", "\n")
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["high"] + 1))
    ends = F.concat(F.transform("cuts", lambda c: c["low"]), F.array(F.size("text_lines")))
    left = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice("text_lines", s + 1, e - s)))
    return (
        rows.join(cuts, "row", "left")
        .withColumn("text_lines", text_lines)
        .select(
            "doc",
            F.when(F.col("cuts").isNull(), F.col("doc.text")).otherwise(F.array_join(left, "\n")).alias("kept"),
            F.when(F.col("doc.text").isNull(), 0).otherwise(F.size("text_lines")).alias("n_lines"),
            F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"),
        )
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(with_columns_kept(read_table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc.doc_id", "n_lines", "n_removed", "n_runs", F.md5("kept").alias("kept_md5"))


#: The same by definition: a line goes if a window of MIN_LINES lines that covers it, or the long line itself, occurred before.
OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents WHERE text IS NOT NULL),
shown AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos FROM lines WHERE regexp_matches(line, '[^\\s]')),
windows AS (
  SELECT doc_id, pos, line, {', '.join(f"lead(line, {k}) OVER (PARTITION BY doc_id ORDER BY pos) AS l{k}" for k in range(1, MIN_LINES))} FROM shown),
numbered AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line, {', '.join(f'l{k}' for k in range(1, MIN_LINES))} ORDER BY doc_id, pos) AS copy
  FROM windows WHERE l{MIN_LINES - 1} IS NOT NULL),
single AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS copy FROM shown WHERE length(line) >= {LONG_LINE}),
gone AS (
  SELECT DISTINCT doc_id, pos + d.range AS pos FROM numbered CROSS JOIN range(0, {MIN_LINES}) d WHERE copy > 1
  UNION SELECT doc_id, pos FROM single WHERE copy > 1),
islands AS (
  SELECT doc_id, count(*) AS n_removed, count(DISTINCT grp) AS n_runs
  FROM (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM gone) GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS kept
  FROM lines l LEFT JOIN shown s ON l.doc_id = s.doc_id AND l.line_no = s.line_no
  LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.pos = g.pos
  WHERE g.pos IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       coalesce(i.n_removed, 0) AS n_removed, coalesce(i.n_runs, 0) AS n_runs,
       md5(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END) AS kept_md5
FROM documents d LEFT JOIN islands i ON d.doc_id = i.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
