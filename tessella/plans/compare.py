"""Two audits side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What two audits must share to be compared.
BASES = ("scope", "config", "representation", "corpus", "provider")


def comparability(before: dict[str, str | None], after: dict[str, str | None]) -> dict[str, str]:
    """compatible, incompatible or unknown for each basis; an absent one is unknown, never equal."""
    return {b: "unknown" if before.get(b) is None or after.get(b) is None else "compatible" if before[b] == after[b] else "incompatible" for b in BASES}


def compared(before: DataFrame, after: DataFrame, before_urls: DataFrame, after_urls: DataFrame, before_partial: bool = False, after_partial: bool = False) -> DataFrame:
    """check, target_url, change: persisted; appeared or disappeared, where the page is in both audits; entered or left with the
    page.  Findings without a page only enter or leave; what a partial side could not see has entered or left, not changed."""
    key = lambda df, side: df.select("check", F.coalesce("target_url", F.lit("")).alias("target"), F.lit(True).alias(side)).distinct()
    known = lambda df, side: df.select(F.col("url").alias("target"), F.lit(True).alias(side)).distinct()
    both = key(before, "was").join(key(after, "is"), ["check", "target"], "full_outer").join(known(before_urls, "was_there"), "target", "left").join(known(after_urls, "is_there"), "target", "left")
    no = lambda c: F.col(c).isNull()
    site_wide = F.col("target") == ""
    change = (
        F.when(~no("was") & ~no("is"), "persisted")
        .when(no("was"), F.when(site_wide | no("was_there") | F.lit(before_partial), "entered").otherwise("appeared"))
        .otherwise(F.when(site_wide | no("is_there") | F.lit(after_partial), "left").otherwise("disappeared"))
    )
    return both.select("check", F.nullif("target", F.lit("")).alias("target_url"), change.alias("change"))


def evidence_difference(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and `side` of what only one of two collections has."""
    a, b = one.select(*keys).distinct(), other.select(*keys).distinct()
    cond = lambda x, y: [x[k].eqNullSafe(y[k]) for k in keys]
    return a.join(b, cond(a, b), "left_anti").withColumn("side", F.lit("first")).unionByName(b.join(a, cond(b, a), "left_anti").withColumn("side", F.lit("second")))


def body_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """url, variant, representation, sha256 of two runs: state unchanged, changed, missing_evidence or not_comparable."""
    keys = ["url", "variant", "representation"]
    a = before.select(*keys, F.col("sha256").alias("was"), F.lit(True).alias("in_before"))
    b = after.select(*keys, F.col("sha256").alias("is"), F.lit(True).alias("in_after"))
    state: Column = F.when(F.col("in_before").isNull() | F.col("in_after").isNull(), "not_comparable").when(F.col("was").isNull() | F.col("is").isNull(), "missing_evidence").when(F.col("was") == F.col("is"), "unchanged").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, "was", "is", state.alias("state"))
