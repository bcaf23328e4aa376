"""Audits and tasks as documents: JSON that another run can read back, and Markdown of what is bounded.

An audit's document is a folder: `audit` holds one JSON object (the version, the run with the checks that were
skipped or disabled, the summary), `issues` and `pages` hold a JSON object a line, so that no row and no task holds
them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.audit import Audit
from tessella.schemas import PAGE_FIELDS

#: Fixed value: the version that documents carry and that is asked for when they are read.
SCHEMA_VERSION = "2.0"
SEVERITIES = ("critical", "warning", "notice")
ISSUES = "issue bigint, fingerprint string, check string, severity string, target_url string, status_code bigint, occurrences bigint, group_id string, details string"
HEAD = (
    "schema_version string, run struct<checks_skipped: array<struct<check: string, reason: string>>, checks_disabled: array<struct<check: string, reason: string>>>, "
    "summary struct<issues: bigint, pages: bigint, by_severity: map<string, bigint>, by_check: array<struct<check: string, severity: string, issues: bigint, pages: bigint>>, health: bigint, reason: string, coverage: double>"
)


def head(audit: Audit) -> DataFrame:
    """One row: all of an audit that doesn't grow with the site."""
    state = lambda name: F.sort_array(F.collect_list(F.when(F.col("state") == name, F.struct("check", "reason"))))
    run = audit.statuses.agg(F.struct(state("skipped").alias("checks_skipped"), state("disabled").alias("checks_disabled")).alias("run"))
    by_check = audit.by_check().agg(F.sort_array(F.collect_list(F.struct("check", "severity", "issues", "pages"))).alias("by_check"))
    by_severity = audit.by_severity().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "issues")))).alias("by_severity"), F.coalesce(F.sum("issues"), F.lit(0)).alias("issues"))
    pages = audit.site.pages.agg(F.count(F.lit(1)).alias("pages"))
    one = run.crossJoin(by_check).crossJoin(by_severity).crossJoin(pages).crossJoin(audit.score())
    return one.select(F.lit(SCHEMA_VERSION).alias("schema_version"), "run", F.struct("issues", "pages", "by_severity", "by_check", "health", "reason", "coverage").alias("summary"))


def write_audit(audit: Audit, path: str) -> None:
    head(audit).coalesce(1).write.json(f"{path}/audit")
    audit.issues().write.json(f"{path}/issues")
    measured = [c for c in audit.site.pages.columns if c in PAGE_FIELDS and c in audit.site.fields | {"url"}]
    audit.site.pages.select(*measured).write.json(f"{path}/pages")


def read_audit(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """audit, issues and pages of a written audit; a document of another version is an error."""
    found = spark.read.schema(HEAD).json(f"{path}/audit")
    versions = [r.schema_version for r in found.select("schema_version").limit(2).collect()]
    if versions != [SCHEMA_VERSION]:
        raise ValueError(f"not an audit of version {SCHEMA_VERSION}: {versions}")
    return {"audit": found, "issues": spark.read.schema(ISSUES).json(f"{path}/issues"), "pages": spark.read.json(f"{path}/pages")}


def audit_markdown(audit: Audit) -> str:
    """The summary: health, issues by severity, and a line for each check that fired."""
    row = head(audit).first()
    s = row.summary
    lines = ["# Audit", "", f"Pages: {s.pages}. Issues: {s.issues}. Health: {'not scored, ' + s.reason if s.health is None else s.health}.", "", "| Severity | Issues |", "|---|---|"]
    lines += [f"| {x} | {(s.by_severity or {}).get(x, 0)} |" for x in SEVERITIES]
    lines += ["", "| Check | Severity | Issues | Pages |", "|---|---|---|---|"]
    ranked = sorted(s.by_check, key=lambda c: (SEVERITIES.index(c.severity), c.check))
    lines += [f"| {c.check} | {c.severity} | {c.issues} | {c.pages} |" for c in ranked]
    for title, own in (("Skipped", row.run.checks_skipped), ("Disabled", row.run.checks_disabled)):
        lines += ["", f"## {title}", ""] + [f"- {c.check}: {c.reason}" for c in own]
    return "\n".join(lines) + "\n"


def write_tasks(tasks: DataFrame, path: str) -> None:
    """A JSON object for each task."""
    tasks.write.json(path)


def tasks_markdown(tasks: DataFrame) -> DataFrame:
    """key, markdown: a section for each task, with the addresses it shows and how many more there are."""
    urls = F.array_join(F.transform("urls", lambda u: F.concat(F.lit("- "), u)), "\n")
    more = F.when(F.col("more") > 0, F.concat(F.lit("\n- and "), F.col("more").cast("string"), F.lit(" more"))).otherwise("")
    title = F.concat(F.lit("## ["), F.col("priority"), F.lit("] "), F.col("key"), F.lit("\n\nAffected: "), F.col("affected").cast("string"), F.lit(", effort: "), F.col("effort"), F.lit("\n\n"))
    return tasks.select("key", F.concat(title, urls, more, F.lit("\n")).alias("markdown"))
