"""Segments of a site: rules over page fields, in the order in which they build on each other."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import urls

OPERATIONS = ("prefix", "contains", "eq", "regex", "in", "segment")


@dataclass(frozen=True)
class Rule:
    field: str
    op: str
    value: str | tuple[str, ...]

    def __post_init__(self) -> None:
        if self.op not in OPERATIONS:
            raise ValueError(f"unknown operation: {self.op}")

    def when(self) -> Column:
        if self.op == "segment":
            return F.col(f"segment_{self.value}")
        c = urls.path(F.col("url")) if self.field == "path" else F.col(self.field)
        hit = {"prefix": lambda: c.startswith(self.value), "contains": lambda: c.contains(self.value), "eq": lambda: c == self.value, "regex": lambda: c.rlike(self.value), "in": lambda: c.isin(*self.value)}[self.op]()
        return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class Segment:
    """A page is in it if all of its rules hold, or one of them if `any`."""

    name: str
    rules: tuple[Rule, ...]
    any: bool = False


def ordered(segments: list[Segment]) -> list[Segment]:
    """Each after those it builds on, else as given; a cycle is an error that names it."""
    by_name = {s.name: s for s in segments}
    place = {s.name: k for k, s in enumerate(segments)}
    needs = {s.name: {r.value for r in s.rules if r.op == "segment"} for s in segments}
    for name, need in needs.items():
        if unknown := need - by_name.keys():
            raise ValueError(f"{name} builds on unknown segments: {', '.join(sorted(map(str, unknown)))}")
    ready = [place[n] for n, need in needs.items() if not need]
    heapq.heapify(ready)
    out: list[Segment] = []
    while ready:
        one = segments[heapq.heappop(ready)]
        out.append(one)
        for n, need in needs.items():
            if one.name in need:
                need.discard(one.name)
                if not need:
                    heapq.heappush(ready, place[n])
    if len(out) < len(segments):
        left = {n: need for n, need in needs.items() if need and by_name[n] not in out}
        path = [min(left, key=place.__getitem__)]
        while path[-1] not in path[:-1]:
            path.append(min(left[path[-1]], key=place.__getitem__))
        raise ValueError(f"segments build on each other in a circle: {' -> '.join(path[path.index(path[-1]):])}")
    return out


def segmented(pages: DataFrame, segments: list[Segment]) -> DataFrame:
    """The pages with a flag for each segment and `primary_segment`, the first given one that holds, or 'unsegmented'."""
    out = pages
    for s in ordered(segments):
        flags = [r.when() for r in s.rules]
        hit = flags[0]
        for f in flags[1:]:
            hit = (hit | f) if s.any else (hit & f)
        out = out.withColumn(f"segment_{s.name}", hit)
    primary = F.coalesce(*[F.when(F.col(f"segment_{s.name}"), F.lit(s.name)) for s in segments], F.lit("unsegmented"))
    return out.withColumn("primary_segment", primary)


def report(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """segment, pages, issues; the sums are those of the whole site (findings on no crawled page are unsegmented)."""
    n = pages.groupBy(F.col("primary_segment").alias("segment")).agg(F.count(F.lit(1)).alias("pages"))
    by_url = pages.groupBy("url").agg(F.first("primary_segment").alias("segment"))
    issues = findings.join(by_url, findings.target_url == by_url.url, "left").groupBy(F.coalesce("segment", F.lit("unsegmented")).alias("segment")).agg(F.count(F.lit(1)).alias("issues"))
    return n.join(issues, "segment", "full_outer").select("segment", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("issues", F.lit(0)).alias("issues"))


def counterparts(pages: DataFrame, alternates: DataFrame, source_prefix: str, target_prefix: str, least_mirror_rate: float = 0.5) -> DataFrame:
    """url, counterpart, basis: the declared alternate of each page under one prefix, else the page under the other one with the
    same path, if enough of the declared pairs are such pairs.  basis: declared, mirrored, missing, or unmeasured."""
    own = pages.where(urls.path(F.col("url")).startswith(source_prefix)).select("url", urls.norm_url(F.col("url")).alias("key"))
    theirs = pages.where(urls.path(F.col("url")).startswith(target_prefix)).select(F.col("url").alias("other"), urls.norm_url(F.col("url")).alias("other_key"))
    declared = alternates.select(urls.norm_url(F.col("source_url")).alias("key"), urls.norm_url(F.col("destination_url")).alias("other_key")).join(theirs, "other_key").groupBy("key").agg(F.min("other").alias("declared"))
    swapped = urls.norm_url(F.regexp_replace(F.col("url"), F.lit(r"^([a-zA-Z]+://[^/]+)\Q" + source_prefix + r"\E"), F.concat(F.lit("$1"), F.lit(target_prefix.replace("$", r"\$")))))
    placed = own.withColumn("mirror_key", swapped).join(declared, "key", "left").join(theirs.select(F.col("other").alias("mirrored"), F.col("other_key").alias("mirror_key")).dropDuplicates(["mirror_key"]), "mirror_key", "left")
    rate = placed.where("declared is not null").agg(F.avg((urls.norm_url(F.col("declared")) == F.col("mirror_key")).cast("int")).alias("rate"))
    trusted = F.coalesce(F.col("rate") >= least_mirror_rate, F.lit(False))
    basis = F.when(F.col("declared").isNotNull(), "declared").when(~trusted, "unmeasured").when(F.col("mirrored").isNotNull(), "mirrored").otherwise("missing")
    return placed.crossJoin(F.broadcast(rate)).select("url", F.when(basis == "declared", F.col("declared")).when(basis == "mirrored", F.col("mirrored")).alias("counterpart"), basis.alias("basis"), F.bround("rate", 4).alias("mirror_rate"))
