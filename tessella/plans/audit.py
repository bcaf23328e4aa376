"""An audit: all checks that can be judged, the findings, what became of every check, and the summary.

fired, disabled, skipped and silent are a partition of the registry.  On a partial crawl, checks that need
the whole site are withheld after they ran, fired or not.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import values
from tessella.operators.shared import written
from tessella.plans import group_checks, link_checks, page_checks
from tessella.plans.link_checks import Site
from tessella.plans.registry import CHECKS, IMAGE_CHECKS, NEEDS_WHOLE_SITE, SEVERITY_RANK
from tessella.plans.settings import Settings
from tessella.schemas import FINDINGS, PAGE_FIELDS, page_type

#: Of all checks, so many must have been judged for a score.
LEAST_COVERAGE = 0.5
SHOWN_LOCATIONS = 200


def site_of(pages: DataFrame, frames: dict[str, DataFrame] | None = None, **about: object) -> Site:
    """A site from pages with any of the canonical fields; what is absent is remembered as not measured."""
    have = frozenset(pages.columns) & frozenset(PAGE_FIELDS)
    whole = pages.select(*[(F.col(f) if f in have else F.lit(None)).cast(page_type(f)).alias(f) for f in PAGE_FIELDS], (F.col("ordinal") if "ordinal" in pages.columns else F.monotonically_increasing_id()).alias("ordinal"))
    return Site(group_checks.with_identity(whole), dict(frames or {}), have, **about)


@dataclass
class Audit:
    findings: DataFrame
    statuses: DataFrame
    site: Site
    settings: Settings

    def by_severity(self) -> DataFrame:
        return self.findings.groupBy("severity").agg(F.count(F.lit(1)).alias("issues"))

    def by_check(self) -> DataFrame:
        return self.findings.groupBy("check", "severity").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("target_url").alias("pages"))

    def coverage(self) -> DataFrame:
        return self.statuses.groupBy("state").agg(F.count(F.lit(1)).alias("checks"))

    def implausible(self) -> DataFrame:
        """Checks that fire on more than half of the pages, which says more about the crawl than about the pages."""
        n = self.site.pages.agg(F.count(F.lit(1)).alias("n"))
        return self.findings.where(~F.col("check").isin(*IMAGE_CHECKS)).groupBy("check").agg(F.countDistinct("target_url").alias("pages")).crossJoin(F.broadcast(n)).where("2 * pages > n").select("check", "pages", F.bround(F.col("pages") / F.col("n"), 4).alias("share"))

    def score(self) -> DataFrame:
        """One row: health (0 to 100, half to even; null with a reason where it would mislead), reason, coverage."""
        weights = self.settings.values["weights"]
        weight = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        lost = self.findings.agg(F.coalesce(F.sum(weight[F.col("severity")]), F.lit(0.0)).alias("lost"))
        n = self.site.pages.agg(F.count(F.lit(1)).alias("n"))
        judged = self.statuses.agg((F.count_if(F.col("state").isin("fired", "silent")) / F.count_if(F.col("state") != "disabled")).alias("coverage"))
        one = lost.crossJoin(n).crossJoin(judged)
        reason = F.when(F.col("n") == 0, "no pages").when(F.col("coverage") < LEAST_COVERAGE, "under half of the checks were measured")
        value = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.col("lost") / F.greatest(F.col("n"), F.lit(1)) * 10)), 0)
        return one.select(F.when(reason.isNull(), value).cast("bigint").alias("health"), reason.alias("reason"), F.bround("coverage", 4).alias("coverage"))

    def issues(self) -> DataFrame:
        """The findings in their order, numbered, with a fingerprint that is the same in the next audit."""
        rank = F.create_map(*[F.lit(x) for k, v in SEVERITY_RANK.items() for x in (k, v)])
        # Numbers come from sorted partitions and their sizes, not from one partition that holds all rows.
        sorted_ = self.findings.withColumn("rank", rank[F.col("severity")]).repartitionByRange("rank", "check", F.coalesce("target_url", F.lit("None"))).sortWithinPartitions("rank", "check", F.coalesce("target_url", F.lit("None")))
        return sorted_.withColumn("issue", F.monotonically_increasing_id()).drop("rank").withColumn("fingerprint", values.fingerprint(F.col("check"), F.col("target_url"), F.col("status_code")))


def merged(findings: DataFrame) -> DataFrame:
    """One finding for each check and target; findings without a target all stay."""
    keyed = findings.where("target_url is not null").groupBy("check", "target_url").agg(
        F.first("severity").alias("severity"), F.min("status_code").alias("status_code"), F.max("occurrences").alias("occurrences"), F.min("group_id").alias("group_id"), F.min("details").alias("details")
    )
    return keyed.select("check", "severity", "target_url", "status_code", "occurrences", "group_id", "details").unionByName(findings.where("target_url is null"))


def run_audit(site: Site, settings: Settings | None = None) -> Audit:
    """Pages and frames are written down once, so that the checks, each of which reads them, don't make them anew; so are the findings."""
    s = settings or Settings()
    site = replace(site, pages=written(site.pages, "audit-pages"), frames={k: written(f, f"audit-{k}") for k, f in site.frames.items()})
    spark = site.spark
    fields = site.fields | ({"url"} if "url" in site.pages.columns else set())
    states: dict[str, tuple[str, str | None]] = {}
    chosen = []
    for name, check in CHECKS.items():
        missing = check.missing(fields, frozenset(site.frames))
        if not s.enabled(name):
            states[name] = "disabled", "switched off in the settings"
        elif name == "H2_MISSING" and not s.requires("h2") or name == "CANONICAL_MISSING" and not s.requires("canonical"):
            states[name] = "skipped", "not required by the settings"
        elif missing:
            states[name] = "skipped", missing
        elif site.partial and name in NEEDS_WHOLE_SITE:
            states[name] = "skipped", "withheld: the crawl is partial"
        elif name in ("BROKEN_INTERNAL_LINK", "LINK_TO_5XX", "INTERNAL_LINK_TO_REDIRECT", "ONLY_NOFOLLOW_INLINKS", "ONLY_NONINDEXABLE_SOURCE_INLINKS", "DUPLICATE_INTERNAL_LINK", "FOLLOW_AND_NOFOLLOW_INLINKS") and site.host is None:
            states[name] = "skipped", "the site's host is unknown"
        else:
            chosen.append(name)
    pages = site.pages
    if "OG_MISSING" in chosen and pages.where(~page_checks.blank("og_title") | ~page_checks.blank("og_description") | ~page_checks.blank("og_image") | ~page_checks.blank("og_url")).isEmpty():
        chosen.remove("OG_MISSING")
        states["OG_MISSING"] = "skipped", "no page carries Open Graph values"
    local = [c for c in chosen if c in page_checks.page_checks(s)]
    out = page_checks.findings(pages, s, local) if local else spark.createDataFrame([], FINDINGS)
    for name in chosen:
        if name in group_checks.GROUP_CHECKS:
            out = out.unionByName(group_checks.GROUP_CHECKS[name](pages, s))
        elif name in link_checks.SITE_CHECKS:
            out = out.unionByName(link_checks.SITE_CHECKS[name](site, s))
    out = written(merged(out), "audit-findings")
    unmeasured = [c for c in ("TITLE_MISSING", "DESC_MISSING", "H1_MISSING", "CANONICAL_MISSING") if c in chosen]
    registry = spark.createDataFrame([(c, CHECKS[c].severity, *states.get(c, (None, None))) for c in CHECKS], "check string, severity string, state string, reason string")
    fired = out.groupBy("check").agg(F.count(F.lit(1)).alias("issues"))
    oversized = pages.where(page_checks.is_html() & ~page_checks.blank("body_unavailable")).agg(F.count(F.lit(1)).alias("oversized"))
    judged = registry.join(fired, "check", "left").crossJoin(F.broadcast(oversized))
    partly = F.col("check").isin(*unmeasured) & (F.col("oversized") > 0) if unmeasured else F.lit(False)
    state = F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("issues") > 0, "fired").when(partly, "skipped").otherwise("silent")
    reason = F.when(F.col("state").isNotNull(), F.col("reason")).when(F.col("issues").isNull() & partly, F.concat(F.col("oversized").cast("string"), F.lit(" pages with a body too large to read")))
    statuses = judged.select("check", "severity", state.alias("state"), reason.alias("reason"), F.coalesce("issues", F.lit(0)).alias("issues"))
    return Audit(out, statuses, site, s)
