"""Tasks out of findings: one for each kind of problem, or one for each page and problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.settings import Settings


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def tasks(findings: DataFrame, settings: Settings) -> DataFrame:
    """key, check, severity, priority, effort, affected, occurrences, urls (the first of them), more (those not shown)."""
    t = settings.values["tasks"]
    chosen = findings.where(F.col("severity").isin(*t["include_severities"]))
    if t["include_checks"]:
        chosen = chosen.where(F.col("check").isin(*t["include_checks"]))
    if t["exclude_checks"]:
        chosen = chosen.where(~F.col("check").isin(*t["exclude_checks"]))
    by = ["check", "severity"] + (["target_url"] if t["group_by"] == "issue" else [])
    grouped = chosen.groupBy(*by).agg(F.countDistinct("target_url").alias("affected"), F.sum("occurrences").alias("occurrences")).where(F.col("occurrences") >= t["min_occurrences"])
    n = int(t["max_urls_per_task"])
    if t["group_by"] == "issue":
        key, shown = F.concat_ws("|", F.col("check"), F.col("target_url")), F.filter(F.array("target_url"), lambda u: u.isNotNull())
    else:  # only the first of a check's pages are gathered
        nth = F.row_number().over(Window.partitionBy("check", "severity").orderBy("target_url"))
        first = chosen.where("target_url is not null").select("check", "severity", "target_url").distinct().withColumn("nth", nth).where(F.col("nth") <= n)
        urls = first.groupBy("check", "severity").agg(F.sort_array(F.collect_list("target_url")).alias("first_urls"))
        grouped = grouped.join(urls, ["check", "severity"], "left")
        key, shown = F.col("check"), F.coalesce("first_urls", F.array().cast("array<string>"))
    out = grouped.select(key.alias("key"), "check", "severity", _map(t["priority_map"])[F.col("severity")].alias("priority"), _map(t["effort_map"])[F.col("severity")].alias("effort"), "affected", "occurrences", F.slice(shown, 1, n).alias("urls"), F.greatest(F.col("affected") - n, F.lit(0)).cast("int").alias("more"))
    return out.orderBy("priority", F.col("affected").desc(), "key")
