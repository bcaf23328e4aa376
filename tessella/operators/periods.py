"""Comparison of periods: windows, alignment by day, changes, shares, rollups by several dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import values


def windows(end: Column, months: int) -> tuple[Column, Column, Column, Column]:
    """First and last day of the period of so many months up to `end`, and of the equal one before it."""
    start = F.date_add(F.add_months(end, -months), 1)
    days = F.datediff(end, start)
    return start, end, F.date_sub(start, days + 1), F.date_sub(start, 1)


def totals(rows: DataFrame, day: str, value: str, end: str, months: int) -> DataFrame:
    """One row: now, before, change (percent, null without a base) of a value over the period and the one before it."""
    start, last, start2, last2 = windows(F.lit(end).cast("date"), months)
    d = F.to_date(day)
    one = rows.agg(F.coalesce(F.sum(F.when(d.between(start, last), F.col(value))), F.lit(0)).alias("now"), F.coalesce(F.sum(F.when(d.between(start2, last2), F.col(value))), F.lit(0)).alias("before"))
    return one.withColumn("change", values.change_percent(F.col("now"), F.col("before")))


def breakdown(rows: DataFrame, day: str, dimension: str, value: str, end: str, months: int, shown: int = 10) -> DataFrame:
    """dimension, now, before, share (percent of the period), change, status (ok, new, no_baseline, unavailable, unknown); the rest as 'other'."""
    start, last, start2, last2 = windows(F.lit(end).cast("date"), months)
    d = F.to_date(day)
    label = F.coalesce(F.col(dimension).cast("string"), F.lit("unknown"))
    sums = rows.groupBy(label.alias("dimension")).agg(F.sum(F.when(d.between(start, last), F.col(value))).alias("now"), F.sum(F.when(d.between(start2, last2), F.col(value))).alias("before"))
    rank = F.row_number().over(Window.orderBy(F.coalesce("now", F.lit(0)).desc(), "dimension"))
    # The window sees one row for each value of the dimension; it keeps the first ones and sums up the others.
    named = sums.withColumn("k", rank).withColumn("dimension", F.when(F.col("k") <= shown, F.col("dimension")).otherwise("other"))
    folded = named.groupBy("dimension").agg(F.sum("now").alias("now"), F.sum("before").alias("before"))
    whole = folded.agg(F.sum("now").alias("whole"), F.sum("before").alias("whole_before"))
    status = (
        F.when(F.col("dimension") == "unknown", "unknown")
        .when(F.col("now").isNull() & F.col("before").isNull(), "unavailable")
        .when(F.coalesce("whole_before", F.lit(0)) == 0, "no_baseline")
        .when(F.coalesce("before", F.lit(0)) == 0, "new")
        .otherwise("ok")
    )
    return folded.crossJoin(F.broadcast(whole)).select("dimension", F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("before", F.lit(0)).alias("before"), F.when(F.col("whole") != 0, F.bround(F.coalesce("now", F.lit(0)) / F.col("whole") * 100, 2)).alias("share"), values.change_percent(F.coalesce("now", F.lit(0)), F.col("before")).alias("change"), status.alias("status"))


def aligned_days(rows: DataFrame, day: str, value: str, end: str, months: int) -> DataFrame:
    """at (day of the period, from 0), now, before: the days of both periods side by side; days without rows are null."""
    start, last, start2, last2 = windows(F.lit(end).cast("date"), months)
    d = F.to_date(day)
    pick = lambda a, b, name: rows.where(d.between(a, b)).groupBy(F.datediff(d, a).alias("at")).agg(F.sum(value).alias(name))
    spine = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.datediff(last, start))).alias("at"))
    return spine.join(pick(start, last, "now"), "at", "left").join(pick(start2, last2, "before"), "at", "left")


def spend(rows: DataFrame) -> DataFrame:
    """dimension (source, operation, day), value, unit, measured, uncertain: rows: source, operation, at, unit, amount, measured."""
    day = F.to_date("at").cast("string")
    base = rows.select("source", "operation", day.alias("day"), "unit", F.when(F.col("measured"), F.col("amount")).alias("m"), F.when(~F.col("measured"), F.col("amount")).alias("u"))
    base.createOrReplaceTempView("spend_rows")
    return rows.sparkSession.sql(
        """SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(operation) = 0 THEN 'operation' ELSE 'day' END AS dimension,
                  coalesce(source, operation, day) AS value, unit, coalesce(sum(m), 0) AS measured, coalesce(sum(u), 0) AS uncertain
           FROM spend_rows GROUP BY GROUPING SETS ((source, unit), (operation, unit), (day, unit))"""
    )


def search_rows(rows: DataFrame) -> DataFrame:
    """clicks, impressions, position, ctr (from clicks where it isn't given), by clicks; and the keys as they are."""
    return rows.withColumn("ctr", F.coalesce("ctr", F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions")))).orderBy(F.col("clicks").desc(), F.col("impressions").desc())
