"""Joins of crawled pages with rows from elsewhere, and of declared with observed URLs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import urls


@dataclass
class ExternalJoin:
    """All parts of a full outer join on a URL key; rows that can't be keyed are counted, not lost."""

    joined: DataFrame
    crawl_only: DataFrame
    external_only: DataFrame
    unkeyable_pages: DataFrame
    unkeyable_rows: DataFrame
    crawl_origins: DataFrame

    def summary(self) -> DataFrame:
        parts = [("joined", self.joined), ("crawl_only", self.crawl_only), ("external_only", self.external_only), ("unkeyable_pages", self.unkeyable_pages), ("unkeyable_rows", self.unkeyable_rows)]
        out = None
        for name, df in parts:
            one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
            out = one if out is None else out.unionByName(one)
        return out


def external_join(pages: DataFrame, rows: DataFrame, page_url: str = "url", row_url: str = "url", **flags: bool) -> ExternalJoin:
    """Every pair of page and row with one key; ignore_query, ignore_scheme and casefold_path widen the key."""
    if row_url not in rows.columns:
        raise ValueError(f"no column {row_url}; there are {', '.join(rows.columns)}")
    a = pages.withColumn("join_key", urls.join_key(F.col(page_url), **flags))
    b = rows.select(F.struct("*").alias("external"), urls.join_key(F.col(row_url), **flags).alias("join_key"))
    a_ok, b_ok = a.where("join_key is not null"), b.where("join_key is not null")
    return ExternalJoin(
        a_ok.join(b_ok, "join_key"),
        a_ok.join(b_ok.select("join_key"), "join_key", "left_anti"),
        b_ok.join(a_ok.select("join_key"), "join_key", "left_anti"),
        a.where("join_key is null").drop("join_key"),
        b.where("join_key is null").select("external"),
        a_ok.select(urls.origin_of_key(F.col("join_key")).alias("origin")).distinct(),
    )


def orphan_rows(joined: ExternalJoin, origins: DataFrame | None = None) -> DataFrame:
    """External rows of the crawled origins (or those given) that the crawl doesn't have."""
    allowed = origins if origins is not None else joined.crawl_origins
    return joined.external_only.withColumn("origin", urls.origin_of_key(F.col("join_key"))).join(allowed, "origin", "left_semi")


def reconcile(declared: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """key, state: healthy (declared, linked), orphan (declared, not linked), missing (a page to declare that is linked, not
    declared), linked_not_comparable (linked, but not a page to declare).  declared: loc; pages: url, comparable; links: destination."""
    d = declared.select(urls.sitemap_key(F.col("loc")).alias("key"), F.lit(True).alias("declared")).where("key is not null").distinct()
    seen = links.select(urls.sitemap_key(F.col("destination")).alias("key"), F.lit(True).alias("linked")).where("key is not null").distinct()
    own = pages.select(urls.sitemap_key(F.col("url")).alias("key"), "comparable").where("key is not null").groupBy("key").agg(F.bool_or("comparable").alias("comparable"))
    has: Column = F.col("declared").isNotNull()
    linked = F.col("linked").isNotNull()
    state = F.when(has & linked, "healthy").when(has, "orphan").when(linked & F.coalesce("comparable", F.lit(False)), "missing").when(linked, "linked_not_comparable")
    return d.join(seen, "key", "full_outer").join(own, "key", "left").select("key", state.alias("state"))


def language_states(pages: DataFrame, hreflang: DataFrame) -> DataFrame:
    """url, self_reference, x_default, reciprocity: present, missing, or unmeasured where the page's declarations weren't read."""
    tags = hreflang.select(urls.norm_url(F.col("source_url")).alias("a"), urls.norm_url(F.col("destination_url")).alias("b"), F.lower(F.trim("hreflang")).alias("code"))
    back = tags.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("answered")).distinct()
    judged = tags.join(back, ["a", "b"], "left").groupBy("a").agg(F.bool_or(F.expr("a = b")).alias("self_reference"), F.bool_or(F.expr("code = 'x-default'")).alias("x_default"), F.bool_and(F.expr("a = b or answered is not null")).alias("reciprocity"))
    state = lambda c: F.when(~F.col("measured"), "unmeasured").when(F.coalesce(F.col(c), F.lit(False)), "present").otherwise("missing")
    return pages.select("url", "measured", urls.norm_url(F.col("url")).alias("a")).join(judged, "a", "left").select("url", *[state(c).alias(c) for c in ("self_reference", "x_default", "reciprocity")])


def duplicate_rows(df: DataFrame, identity: list[str]) -> DataFrame:
    """One row: groups (identities that occur again), rows (in them); rows without a full identity aren't compared."""
    whole = df.where(" and ".join(f"`{c}` is not null" for c in identity))
    return whole.groupBy(*identity).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def reverse_links(links: DataFrame, target: str, after: int = -1, limit: int = 100) -> DataFrame:
    """A page of the links to one URL, whatever their fragment, in order of seq: those after the last one shown."""
    key = urls.crawl_key(F.regexp_replace(F.lit(target), "#.*$", ""))
    return links.where((urls.crawl_key(F.col("destination")) == key) & (F.col("seq") > after)).orderBy("seq").limit(limit)
