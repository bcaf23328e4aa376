"""Groups, ranks and pages of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def retained(scans: DataFrame, keep: int) -> DataFrame:
    """scans: host, config, finished, uuid, pinned; with `prune`: all but the newest `keep` of each host and config, pinned ones never."""
    order = Window.partitionBy("host", "config").orderBy(F.col("finished").desc(), F.col("uuid").desc())
    return scans.withColumn("rank", F.row_number().over(order)).withColumn("prune", (F.col("rank") > keep) & ~F.coalesce("pinned", F.lit(False))).drop("rank")


def streaks(df: DataFrame, by: str, order: str, bad: Column) -> DataFrame:
    """by, streak (longest run of bad rows in order), current (length of the run at the end)."""
    marked = df.select(by, F.col(order).alias("o"), F.coalesce(bad, F.lit(False)).alias("bad"))
    islands = marked.withColumn("island", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(Window.partitionBy(by).orderBy("o")))
    runs = islands.groupBy(by, "island").agg(F.count_if("bad").alias("n"), F.max("o").alias("last"))
    return runs.groupBy(by).agg(F.max("n").alias("streak"), F.max_by("n", "last").alias("current"))


def value_groups(df: DataFrame, value: Column, member: str) -> DataFrame:
    """value, n, members (sorted) of values that several rows have."""
    return df.select(value.alias("value"), F.col(member).alias("m")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("m")).alias("members")).where("n > 1")


def size_report(df: DataFrame, size: str) -> DataFrame:
    """One row: n, median, p75, p90, p95, iqr, most, by linear interpolation."""
    p = F.percentile(size, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95))))
    return df.agg(F.count(size).alias("n"), p.alias("p"), F.max(size).alias("most")).select("n", F.col("p")[1].alias("median"), F.col("p")[2].alias("p75"), F.col("p")[3].alias("p90"), F.col("p")[4].alias("p95"), (F.col("p")[2] - F.col("p")[0]).alias("iqr"), "most")


def outliers(df: DataFrame, size: str) -> DataFrame:
    """Rows above the upper fence, if the sizes are spread enough for a fence to mean something, with their rank by size."""
    stats = size_report(df, size)
    fence = F.col("p75") + 1.5 * F.col("iqr")
    above = df.crossJoin(F.broadcast(stats)).where((F.col("iqr") >= 0.1 * F.col("median")) & (F.col(size) > fence)).withColumn("fence", fence)
    return above.drop("n", "median", "p75", "p90", "p95", "iqr", "most")


def payload_outliers(df: DataFrame, size: str, least_excess: int = 100_000) -> DataFrame:
    """Rows over twice the median and by so many bytes, where there are two pages at least."""
    stats = df.agg(F.count(F.lit(1)).alias("pages_n"), F.percentile(size, 0.5).alias("middle"))
    return df.crossJoin(F.broadcast(stats)).where((F.col("pages_n") >= 2) & (F.col(size) > 2 * F.col("middle")) & (F.col(size) - F.col("middle") > least_excess)).drop("pages_n", "middle")


def host_policy(names: DataFrame, host: str = "host") -> DataFrame:
    """One row: www, non_www, dominant (www on a tie), mixed."""
    one = names.where(f"{host} <> ''").agg(F.count_if(F.col(host).startswith("www.")).alias("www"), F.count_if(~F.col(host).startswith("www.")).alias("non_www"))
    return one.select("www", "non_www", F.when(F.col("www") >= F.col("non_www"), "www").otherwise("non_www").alias("dominant"), ((F.col("www") > 0) & (F.col("non_www") > 0)).alias("mixed"))


def samples(df: DataFrame, pattern: Column, n: int, order: str) -> DataFrame:
    """The first n rows of each URL pattern."""
    return top(df.withColumn("pattern", pattern), ["pattern"], [F.col(order)], max(1, n)).drop("rank")


def table_page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def keyset_page(df: DataFrame, key: str, after: int | None, limit: int) -> DataFrame:
    """The next rows by key, without counting over those before."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(limit)


def tag_coverage(pages: DataFrame, tags: str) -> DataFrame:
    """tag, pages, share of all pages; tags: an array column."""
    n = pages.agg(F.count(F.lit(1)).alias("all"))
    return pages.select(F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("pages")).crossJoin(F.broadcast(n)).select("tag", "pages", F.bround(F.col("pages") / F.col("all"), 4).alias("share"))


def field_coverage(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """field, present, missing, invalid, state (complete, partial, unavailable): fields: by column, whether a present value is valid."""
    one = df.agg(*[F.struct(F.lit(f).alias("field"), F.count_if(F.col(f).isNotNull() & ok).alias("present"), F.count_if(F.col(f).isNull()).alias("missing"), F.count_if(F.col(f).isNotNull() & ~F.coalesce(ok, F.lit(False))).alias("invalid")).alias(f"c{k}") for k, (f, ok) in enumerate(fields.items())])
    state = F.when(F.col("present") == 0, "unavailable").when((F.col("missing") == 0) & (F.col("invalid") == 0), "complete").otherwise("partial")
    return one.select(F.explode(F.array(*[F.col(f"c{k}") for k in range(len(fields))])).alias("x")).select("x.*").withColumn("state", state)
