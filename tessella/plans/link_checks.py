"""Checks over links, language versions, forms, sitemaps and other frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import urls, values
from tessella.operators import graph
from tessella.plans.group_checks import found, representatives
from tessella.plans.page_checks import blank, is_html, is_indexable
from tessella.plans.settings import Settings


@dataclass
class Site:
    """What an audit looks at.  frames: by name, only those that were collected; fields: page fields that were measured."""

    pages: DataFrame
    frames: dict[str, DataFrame] = field(default_factory=dict)
    fields: frozenset[str] = frozenset()
    host: str | None = None
    start_url: str | None = None
    partial: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.pages.sparkSession


def defragmented(url: Column) -> Column:
    return urls.norm_url(F.regexp_replace(url, "#.*$", ""))


def by_destination(check: str, frames: tuple[str, ...], internal: bool) -> Callable[[Site, Settings], DataFrame]:
    """Links of exports to destinations that fail, by destination: distinct sources, and where they are."""

    def run(site: Site, s: Settings) -> DataFrame:
        parts = [site.frames[f] for f in frames if f in site.frames]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        own = urls.host(F.col("destination_url")) == F.lit(site.host)
        rows = rows.where(own if internal else ~own).withColumn("key", urls.norm_url(F.col("destination_url")))
        places = rows.groupBy("key", F.coalesce("link_position", F.lit("")).alias("position")).agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("position", "n")))).alias("positions"))
        redirects = site.pages.where(~blank("redirect_url")).groupBy("key").agg(F.min("redirect_url").alias("final_url"))
        totals = rows.groupBy("key").agg(F.min("destination_url").alias("url"), F.min("status_code").alias("status_code"), F.countDistinct("source_url").alias("sources"), F.count(F.lit(1)).alias("rows"), F.slice(F.sort_array(F.collect_set("source_url")), 1, 20).alias("examples"))
        b = totals.join(places, "key").join(redirects, "key", "left")
        return found(b, check, s, F.col("url"), {"sources": F.col("examples"), "positions": F.col("positions"), "final_url": F.col("final_url")}, status=F.col("status_code"), occurrences=F.when(F.col("sources") > 0, F.col("sources")).otherwise(F.col("rows")))

    return run


#: Anchors that say nothing about where they lead.
GENERIC = (
    "here", "click here", "read more", "more", "learn more", "link", "this", "this page", "details", "go", "continue", "see more", "view", "download", "website", "page",
    "здесь", "тут", "подробнее", "читать далее", "далее", "ссылка", "ещё", "еще", "узнать больше", "смотреть", "перейти", "скачать", "сайт", "страница", "читать",
)


def plain_anchor(anchor: Column) -> Column:
    return F.trim(F.regexp_replace(values.collapsed(F.lower(F.coalesce(anchor, F.lit("")))), r"[\s.…»>→:!]+$", ""))


def generic_anchors(site: Site, s: Settings) -> DataFrame:
    own = site.frames["links"].where(plain_anchor(F.col("anchor")).isin(*GENERIC)).select("source", "destination", F.lower("anchor").alias("anchor")).distinct()
    b = own.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_list(F.struct("anchor", "destination"))), 1, 20).alias("links"))
    return found(b, "GENERIC_ANCHOR_TEXT", s, F.col("source"), {"links": F.col("links")}, occurrences=F.col("n"))


def keyed_edges(site: Site) -> DataFrame:
    return site.frames["links"].select(urls.norm_url(F.col("source")).alias("src"), urls.norm_url(F.col("destination")).alias("dst"), "seq").where("src <> '' and dst <> ''")


def low_link_score(site: Site, s: Settings) -> DataFrame:
    ranks = graph.page_rank(site.pages.select(F.col("key").alias("node")), keyed_edges(site))
    stats = ranks.agg(F.count(F.lit(1)).alias("n"), F.percentile("score", 0.5).alias("median"))
    own = site.pages.where(is_html() & is_indexable() & ~F.col("crawl_depth").eqNullSafe(F.lit(0))).select("url", "key")
    b = own.join(ranks, F.col("key") == F.col("node")).crossJoin(F.broadcast(stats)).where((F.col("n") >= 5) & (F.col("median") > 0) & (F.col("score") < s.threshold("link_score_low_ratio") * F.col("median")))
    return found(b, "LOW_LINK_SCORE", s, F.col("url"), {"ratio": F.round(F.col("score") / F.col("median"), 3)})


def inlink_flags(site: Site) -> DataFrame:
    """key, any_followed, known_sources, any_indexable_source, examples of the links within the site, by destination without fragment."""
    links = site.frames["links"].where(urls.host(F.col("destination")) == F.lit(site.host)).select(defragmented(F.col("destination")).alias("key"), urls.norm_url(F.col("source")).alias("src"), "source", "nofollow")
    sources = site.pages.groupBy("key").agg(F.bool_or(is_indexable()).alias("indexable")).select(F.col("key").alias("src"), "indexable")
    return links.join(sources, "src", "left").groupBy("key").agg(
        F.bool_or(~F.coalesce("nofollow", F.lit(False))).alias("any_followed"),
        F.count("indexable").alias("known_sources"),
        F.coalesce(F.bool_or("indexable"), F.lit(False)).alias("any_indexable"),
        F.countDistinct("source").alias("n"),
        F.slice(F.sort_array(F.collect_set("source")), 1, 20).alias("examples"),
    )


def inlink_check(check: str, when: str) -> Callable[[Site, Settings], DataFrame]:
    def run(site: Site, s: Settings) -> DataFrame:
        own = representatives(site.pages.where(is_html() & is_indexable() & ~F.col("crawl_depth").eqNullSafe(F.lit(0)))).select("key", "page.url")
        return found(own.join(inlink_flags(site).where(when), "key"), check, s, F.col("url"), {"sources": F.col("examples")}, occurrences=F.col("n"))

    return run


def deep_paths(check: str, threshold: str) -> Callable[[Site, Settings], DataFrame]:
    def run(site: Site, s: Settings) -> DataFrame:
        start = urls.norm_url(F.lit(site.start_url)) if site.start_url else F.lit(None)
        seeds = site.pages.where(F.col("crawl_depth") == 0).select(F.col("key").alias("node"), F.col("ordinal").alias("place")) if not site.start_url else site.spark.range(1).select(start.alias("node"), F.lit(0).alias("place"))
        reached = graph.discovery(keyed_edges(site), seeds)
        far = reached.where(F.col("hops") > s.threshold(threshold))
        own = representatives(site.pages.where(is_html() & is_indexable())).select("key", "page.url")
        b = own.join(far, F.col("key") == F.col("node")).join(graph.paths(reached, far.select("node")), "node")
        shown = F.when(F.size("path") > 20, F.concat(F.slice("path", 1, 5), F.array(F.lit("...")), F.slice("path", -5, 5))).otherwise(F.col("path"))
        return found(b, check, s, F.col("url"), {"hops": F.col("hops"), "path": shown})

    return run


def duplicate_links(site: Site, s: Settings) -> DataFrame:
    own = site.frames["links"].where(urls.host(F.col("destination")) == F.lit(site.host))
    return found(graph.duplicate_links(own), "DUPLICATE_INTERNAL_LINK", s, F.col("source"), {"repeats": F.col("repeats")}, occurrences=F.col("extra"))


def boilerplate_only(site: Site, s: Settings) -> DataFrame:
    keyed = site.frames["links"].select(defragmented(F.col("destination")).alias("destination"), urls.norm_url(F.col("source")).alias("source"), "position")
    b = graph.composition(keyed).where("boilerplate_only").join(representatives(site.pages).select("key", "page.url"), F.col("destination") == F.col("key"))
    return found(b, "INLINK_BOILERPLATE_ONLY", s, F.col("url"), {"positions": F.col("by_position")})


def rel_tokens() -> Column:
    return F.transform(F.coalesce("rel", F.array().cast("array<string>")), lambda r: F.lower(r))


def edge_check(check: str, when: Callable[[Site], Column]) -> Callable[[Site, Settings], DataFrame]:
    """One finding for each source, with how many such links it has."""

    def run(site: Site, s: Settings) -> DataFrame:
        b = site.frames["links"].where(when(site)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_set("destination")), 1, 20).alias("destinations"))
        return found(b, check, s, F.col("source"), {"destinations": F.col("destinations")}, occurrences=F.col("n"))

    return run


def unsafe_blank(site: Site) -> Column:
    return (F.lower("target") == "_blank") & (urls.origin(F.col("source")) != urls.origin(F.col("destination"))) & ~F.arrays_overlap(rel_tokens(), F.array(F.lit("noopener"), F.lit("noreferrer")))


def follow_and_nofollow(site: Site, s: Settings) -> DataFrame:
    own = site.frames["links"].where(urls.host(F.col("destination")) == F.lit(site.host))
    both = own.groupBy(defragmented(F.col("destination")).alias("key")).agg(F.min("destination").alias("url"), F.count_if("nofollow").alias("nofollow"), F.count_if(~F.coalesce("nofollow", F.lit(False))).alias("follow")).where("nofollow > 0 and follow > 0")
    return found(both, "FOLLOW_AND_NOFOLLOW_INLINKS", s, F.col("url"), {"follow": F.col("follow"), "nofollow": F.col("nofollow")}, occurrences=F.col("follow") + F.col("nofollow"))


def insecure_resources(site: Site, s: Settings) -> DataFrame:
    b = site.frames["resources"].where(F.lower("source").startswith("https://") & F.lower("destination").startswith("http://") & ~F.lower("type").isin("hyperlink", "canonical", "hreflang", "rel next", "rel prev")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_set("destination")), 1, 20).alias("resources"))
    return found(b, "INSECURE_SUBRESOURCE", s, F.col("source"), {"resources": F.col("resources")}, occurrences=F.col("n"))


def form_check(check: str) -> Callable[[Site, Settings], DataFrame]:
    def run(site: Site, s: Settings) -> DataFrame:
        fires = F.lower("action").startswith("http://") if check == "FORM_URL_INSECURE" else F.col("has_password") & F.lower("page").startswith("http://")
        b = site.frames["forms"].where(fires).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("action")).alias("actions"))
        return found(b, check, s, F.col("page"), {"actions": F.col("actions")}, occurrences=F.col("n"))

    return run


# -- language versions -------------------------------------------------------------------------------------------


def iso_codes(spark: SparkSession) -> tuple[list[str], list[str]]:
    """Languages and countries as the platform's own tables have them."""
    locale = spark.sparkContext._jvm.java.util.Locale
    return sorted(locale.getISOLanguages()), sorted(locale.getISOCountries())


#: Scripts, and regions that are numbers, that occur in language tags.
SCRIPTS = ("latn", "cyrl", "hans", "hant", "arab", "deva", "hebr", "grek", "jpan", "kore", "thai", "beng", "taml", "geor", "armn", "ethi", "mong", "tibt", "guru", "gujr")


def code_error(spark: SparkSession, code: Column) -> Column:
    """Why a language tag isn't valid; null if it is."""
    languages, countries = iso_codes(spark)
    c = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    parts = F.split(F.regexp_replace(c, "_", "-"), "-")
    language = parts[0]
    rest = F.slice(parts, 2, 10)
    script = F.filter(rest, lambda p: F.length(p) == 4)
    region = F.filter(rest, lambda p: F.length(p) != 4)
    return (
        F.when(c == "", "empty code")
        .when(c == "x-default", None)
        .when(c.contains("_"), "underscore instead of hyphen")
        .when(~language.isin(*languages), "unknown language")
        .when(F.size(rest) > 2, "too many parts")
        .when(F.exists(script, lambda p: ~p.isin(*SCRIPTS)), "unknown script")
        .when(language.isin("en") & F.array_contains(rest, "uk"), "UK is not a region, GB is")
        .when(F.exists(region, lambda p: ~(p.isin(*[x.lower() for x in countries]) | p.rlike(r"^\d{3}$"))), "unknown region")
    )


def tags(site: Site) -> DataFrame:
    """source_url, destination_url, hreflang, a and b (their keys), code."""
    return site.frames["hreflang"].select("source_url", "destination_url", "hreflang", urls.norm_url(F.col("source_url")).alias("a"), urls.norm_url(F.col("destination_url")).alias("b"), F.lower(F.trim("hreflang")).alias("code"))


def by_source(df: DataFrame, check: str, s: Settings, shown: Column) -> DataFrame:
    b = df.groupBy("source_url").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_list(shown)), 1, 20).alias("entries"))
    return found(b, check, s, F.col("source_url"), {"entries": F.col("entries")}, occurrences=F.col("n"))


def hreflang_broken(site: Site, s: Settings) -> DataFrame:
    bad = representatives(site.pages).where((F.col("page.status_code") >= 300) | ~blank("page.redirect_url")).select(F.col("key").alias("b"), "page.status_code")
    return by_source(tags(site).join(bad, "b").dropDuplicates(["source_url", "destination_url"]), "HREFLANG_BROKEN_TARGET", s, F.struct("destination_url", "status_code"))


def hreflang_codes(site: Site, s: Settings) -> DataFrame:
    judged = tags(site).withColumn("error", code_error(site.spark, F.col("hreflang"))).where("error is not null")
    return by_source(judged, "HREFLANG_INVALID_CODE", s, F.struct("hreflang", "error"))


def hreflang_multiple(site: Site, s: Settings) -> DataFrame:
    several = tags(site).where("code <> ''").groupBy("source_url", "code").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return by_source(several, "HREFLANG_MULTIPLE_ENTRIES", s, F.struct("code", "times"))


def hreflang_lacks(check: str, has: str) -> Callable[[Site, Settings], DataFrame]:
    def run(site: Site, s: Settings) -> DataFrame:
        b = tags(site).groupBy("source_url").agg(F.coalesce(F.bool_or(F.expr(has)), F.lit(False)).alias("has"), F.count(F.lit(1)).alias("n")).where("not has")
        return found(b, check, s, F.col("source_url"), {"entries": F.col("n")})

    return run


def hreflang_not_canonical(site: Site, s: Settings) -> DataFrame:
    other = representatives(site.pages).where(~blank("page.canonical")).select(F.col("key").alias("b"), "page.canonical").where(urls.norm_url(F.col("canonical")) != F.col("b"))
    return by_source(tags(site).join(other, "b").dropDuplicates(["source_url", "destination_url"]), "HREFLANG_NOT_CANONICAL", s, F.struct("destination_url", "canonical"))


def hreflang_no_return(site: Site, s: Settings) -> DataFrame:
    edges = tags(site).where("a <> b").select("a", "b").distinct()
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    targets = representatives(site.pages).select(F.col("key").alias("b"), "page.url")
    b = edges.join(back, ["a", "b"], "left_anti").join(targets, "b").groupBy("url").agg(F.sort_array(F.collect_set("a")).alias("sources"))
    return found(b, "HREFLANG_MISSING_RETURN_LINK", s, F.col("url"), {"not_answered": F.slice("sources", 1, 20)}, occurrences=F.size("sources"))


def hreflang_inconsistent(site: Site, s: Settings) -> DataFrame:
    own = tags(site).where("a = b and code not in ('x-default', '')").groupBy(F.col("a").alias("b")).agg(F.sort_array(F.collect_set("code")).alias("self_codes"))
    crawled = representatives(site.pages).select(F.col("key").alias("b"))
    claims = tags(site).where("a <> b and code not in ('x-default', '')").join(own, "b").join(crawled, "b", "left_semi").where(~F.array_contains("self_codes", F.col("code")))
    return by_source(claims.dropDuplicates(["source_url", "b", "code"]), "HREFLANG_INCONSISTENT_CONFIRMATION", s, F.struct("destination_url", "code", "self_codes"))


# -- sitemaps and robots -----------------------------------------------------------------------------------------


def declared(site: Site) -> DataFrame:
    return site.frames["sitemap"].select(urls.sitemap_key(F.col("loc")).alias("key"), "loc", "sitemap").where("key is not null")


def observed(site: Site) -> DataFrame:
    return site.frames["links"].select(urls.sitemap_key(F.col("destination")).alias("key")).where("key is not null").distinct()


def sitemap_orphans(site: Site, s: Settings) -> DataFrame:
    b = declared(site).groupBy("key").agg(F.min("loc").alias("loc")).join(observed(site), "key", "left_anti")
    return found(b, "SITEMAP_ORPHAN", s, F.col("loc"), {})


def comparable(site: Site) -> DataFrame:
    return site.pages.where(is_html() & is_indexable()).select(urls.sitemap_key(F.col("url")).alias("key"), "url").where("key is not null").groupBy("key").agg(F.min("url").alias("url"))


def not_in_sitemap(site: Site, s: Settings) -> DataFrame:
    b = comparable(site).join(observed(site), "key", "left_semi").join(declared(site), "key", "left_anti")
    return found(b, "URL_NOT_IN_SITEMAP", s, F.col("url"), {})


def sitemap_desync(site: Site, s: Settings) -> DataFrame:
    ours, theirs = comparable(site), declared(site).select("key").distinct()
    one = ours.join(theirs, "key", "left_anti").agg(F.count(F.lit(1)).alias("absent")).crossJoin(ours.agg(F.count(F.lit(1)).alias("pages"))).crossJoin(theirs.join(ours, "key", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))).crossJoin(theirs.agg(F.count(F.lit(1)).alias("declared")))
    pct = s.threshold("sitemap_desync_pct_warn")
    b = one.where(((F.col("pages") > 0) & (100 * F.col("absent") >= pct * F.col("pages"))) | ((F.col("declared") > 0) & (100 * F.col("unknown") >= pct * F.col("declared"))))
    return found(b, "SITEMAP_DESYNC", s, F.lit(None).cast("string"), {c: F.col(c) for c in ("absent", "pages", "unknown", "declared")})


def stale_lastmod(site: Site, s: Settings) -> DataFrame:
    now = F.current_timestamp() if "now" not in site.frames else None
    at = F.coalesce(*[F.try_to_timestamp(F.col("lastmod"), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd")])
    rows = site.frames["sitemap"].where("lastmod is not null and trim(lastmod) <> ''").select(at.alias("at"))
    if now is None:
        rows = rows.crossJoin(F.broadcast(site.frames["now"].select(F.col("now").alias("today"))))
    else:
        rows = rows.withColumn("today", now)
    age = F.datediff("today", "at")
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at").isNull()).alias("invalid"), F.count_if(F.col("at") > F.col("today")).alias("future"), F.count_if(age > s.threshold("sitemap_lastmod_stale_days")).alias("stale"), F.countDistinct(F.to_date("at")).alias("dates"), F.min("at").cast("string").alias("oldest"), F.max("at").cast("string").alias("newest"))
    valid = F.col("n") - F.col("invalid")
    b = one.where((F.col("n") > 0) & ((2 * F.col("stale") >= F.greatest(valid, F.lit(1))) | ((F.col("dates") == 1) & (valid > 1)) | (F.col("future") > 0) | (F.col("invalid") > 0)))
    return found(b, "SITEMAP_STALE_LASTMOD", s, F.lit(None).cast("string"), {c: F.col(c) for c in ("n", "invalid", "future", "stale", "dates", "oldest", "newest")})


def too_many_urls(site: Site, s: Settings) -> DataFrame:
    b = site.frames["sitemap"].groupBy("sitemap").agg(F.count(F.lit(1)).alias("n")).where("n > 50000")
    return found(b, "SITEMAP_TOO_MANY_URLS", s, F.col("sitemap"), {"urls": F.col("n")})


def too_large(site: Site, s: Settings) -> DataFrame:
    return found(site.frames["sitemap_documents"].where("bytes > 52428800"), "SITEMAP_TOO_LARGE", s, F.col("sitemap"), {"bytes": F.col("bytes")})


def declared_twice(site: Site, s: Settings) -> DataFrame:
    b = declared(site).groupBy("key").agg(F.min("loc").alias("loc"), F.sort_array(F.collect_set("sitemap")).alias("sitemaps")).where("size(sitemaps) > 1")
    return found(b, "SITEMAP_URL_DUPLICATED", s, F.col("loc"), {"sitemaps": F.col("sitemaps")}, occurrences=F.size("sitemaps"))


def fetch_incomplete(site: Site, s: Settings) -> DataFrame:
    b = site.frames["sitemap_documents"].where("error is not null or truncated").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_set("sitemap")), 1, 20).alias("sitemaps")).where("n > 0")
    return found(b, "SITEMAP_FETCH_INCOMPLETE", s, F.lit(None).cast("string"), {"sitemaps": F.col("sitemaps")}, occurrences=F.col("n"))


#: Fixed value: paths of what a page needs to be shown.
RESOURCE_PATHS = r"(?i)\.(js|css)\b|/_next/|/static/|/assets/|/js/|/css/"


def robots_lines(site: Site) -> DataFrame:
    return site.frames["robots"].select(F.posexplode(F.split("body", r"\r?\n")).alias("at", "line")).select("at", F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1))).alias("name"), F.trim(F.regexp_replace(F.regexp_extract("line", r":\s*(.*)$", 1), r"\s*#.*$", "")).alias("value"))


def robots_blocks(site: Site, s: Settings) -> DataFrame:
    hit = robots_lines(site).where((F.col("name") == "disallow") & F.col("value").rlike(RESOURCE_PATHS))
    b = hit.agg(F.count(F.lit(1)).alias("n"), F.slice(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), 1, 10).alias("rules")).where("n > 0")
    return found(b, "ROBOTS_BLOCKS_RESOURCES", s, F.lit(None).cast("string"), {"rules": F.col("rules")}, occurrences=F.col("n"))


def no_sitemap_line(site: Site, s: Settings) -> DataFrame:
    b = robots_lines(site).agg(F.count_if(F.col("name") == "sitemap").alias("n")).where("n = 0")
    return found(b, "SITEMAP_NOT_IN_ROBOTS", s, F.lit(None).cast("string"), {})


def not_in_anchor(site: Site, s: Settings) -> DataFrame:
    named = site.pages.where(is_html()).select("url", "key", F.explode(F.array_compact(F.array("rel_next", "rel_prev"))).alias("to")).select("url", F.col("key").alias("src"), urls.norm_url(F.col("to")).alias("dst"), "to").where("dst <> ''")
    b = named.join(keyed_edges(site).select("src", "dst").distinct(), ["src", "dst"], "left_anti").groupBy("url").agg(F.sort_array(F.collect_set("to")).alias("targets"))
    return found(b, "PAGINATION_URL_NOT_IN_ANCHOR", s, F.col("url"), {"targets": F.col("targets")}, occurrences=F.size("targets"))


def listed(check: str, frame: str) -> Callable[[Site, Settings], DataFrame]:
    """A filter's own export: every address in it is a finding."""

    def run(site: Site, s: Settings) -> DataFrame:
        return found(site.frames[frame].select("url").where("url is not null").distinct(), check, s, F.col("url"), {})

    return run


SITE_CHECKS: dict[str, Callable[[Site, Settings], DataFrame]] = {
    "BROKEN_INTERNAL_LINK": by_destination("BROKEN_INTERNAL_LINK", ("inlinks_4xx",), True),
    "LINK_TO_5XX": by_destination("LINK_TO_5XX", ("inlinks_5xx",), True),
    "INTERNAL_LINK_TO_REDIRECT": by_destination("INTERNAL_LINK_TO_REDIRECT", ("inlinks_3xx",), True),
    "BROKEN_EXTERNAL_LINK": by_destination("BROKEN_EXTERNAL_LINK", ("inlinks_4xx", "inlinks_5xx"), False),
    "EXTERNAL_LINK_TO_REDIRECT": by_destination("EXTERNAL_LINK_TO_REDIRECT", ("inlinks_3xx",), False),
    "GENERIC_ANCHOR_TEXT": generic_anchors,
    "LOW_LINK_SCORE": low_link_score,
    "ONLY_NOFOLLOW_INLINKS": inlink_check("ONLY_NOFOLLOW_INLINKS", "not any_followed"),
    "ONLY_NONINDEXABLE_SOURCE_INLINKS": inlink_check("ONLY_NONINDEXABLE_SOURCE_INLINKS", "known_sources > 0 and not any_indexable"),
    "DEEP_DISCOVERY_PATH": deep_paths("DEEP_DISCOVERY_PATH", "crawl_depth_max"),
    "DEEP_CLICK_DEPTH": deep_paths("DEEP_CLICK_DEPTH", "click_depth_max"),
    "DUPLICATE_INTERNAL_LINK": duplicate_links,
    "INLINK_BOILERPLATE_ONLY": boilerplate_only,
    "UNSAFE_CROSS_ORIGIN_LINK": edge_check("UNSAFE_CROSS_ORIGIN_LINK", unsafe_blank),
    "PROTOCOL_RELATIVE_LINK": edge_check("PROTOCOL_RELATIVE_LINK", lambda _: F.col("raw_href").startswith("//")),
    "OUTLINK_TO_LOCALHOST": edge_check("OUTLINK_TO_LOCALHOST", lambda _: urls.is_loopback(urls.host(F.col("destination")))),
    "FOLLOW_AND_NOFOLLOW_INLINKS": follow_and_nofollow,
    "INSECURE_SUBRESOURCE": insecure_resources,
    "FORM_URL_INSECURE": form_check("FORM_URL_INSECURE"),
    "FORM_ON_HTTP_URL": form_check("FORM_ON_HTTP_URL"),
    "HREFLANG_BROKEN_TARGET": hreflang_broken,
    "HREFLANG_INVALID_CODE": hreflang_codes,
    "HREFLANG_MULTIPLE_ENTRIES": hreflang_multiple,
    "HREFLANG_MISSING_SELF_REFERENCE": hreflang_lacks("HREFLANG_MISSING_SELF_REFERENCE", "a = b"),
    "HREFLANG_MISSING_XDEFAULT": hreflang_lacks("HREFLANG_MISSING_XDEFAULT", "code = 'x-default'"),
    "HREFLANG_NOT_CANONICAL": hreflang_not_canonical,
    "HREFLANG_MISSING_RETURN_LINK": hreflang_no_return,
    "HREFLANG_INCONSISTENT_CONFIRMATION": hreflang_inconsistent,
    "SITEMAP_ORPHAN": sitemap_orphans,
    "URL_NOT_IN_SITEMAP": not_in_sitemap,
    "SITEMAP_DESYNC": sitemap_desync,
    "SITEMAP_STALE_LASTMOD": stale_lastmod,
    "SITEMAP_TOO_MANY_URLS": too_many_urls,
    "SITEMAP_TOO_LARGE": too_large,
    "SITEMAP_URL_DUPLICATED": declared_twice,
    "SITEMAP_FETCH_INCOMPLETE": fetch_incomplete,
    "ROBOTS_BLOCKS_RESOURCES": robots_blocks,
    "SITEMAP_NOT_IN_ROBOTS": no_sitemap_line,
    "PAGINATION_URL_NOT_IN_ANCHOR": not_in_anchor,
    **{c: listed(c, f) for c, f in (
        ("TITLE_MULTIPLE", "titles_multiple"), ("IMG_MISSING_ALT", "images_missing_alt"), ("HREFLANG_ERROR", "hreflang_errors"), ("SITEMAP_URL_3XX", "sitemap_redirects"), ("SITEMAP_URL_4XX_5XX", "sitemap_non_200"),
        ("SITEMAP_URL_NON_INDEXABLE", "sitemap_non_indexable"), ("MIXED_CONTENT", "security_mixed"), ("MISSING_HSTS", "security_hsts"), ("STRUCTURED_DATA_MISSING", "structured_data_missing"), ("IMG_OVER_KB", "images_over_kb"), ("IMG_MISSING_DIMENSIONS", "images_missing_size"),
    )},
}
