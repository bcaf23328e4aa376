"""Checks that compare pages with each other: duplicate values, canonical and redirect targets, series of pages, sizes.

`pages` carries `ordinal` (crawl order) and `key` (norm_url); two crawled URLs may share a key.  A look-up
takes either the representative of a key, the first that answers 2xx, else the first, or any of its variants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import urls
from tessella.operators import graph
from tessella.plans.page_checks import blank, is_html, is_indexable
from tessella.plans.settings import Settings


def found(df: DataFrame, check: str, settings: Settings, target: Column, details: dict[str, Column], status: Column | None = None, occurrences: Column | None = None, group: Column | None = None) -> DataFrame:
    """Rows of df as findings of one check."""
    return df.select(
        F.lit(check).alias("check"),
        F.lit(settings.severity(check)).alias("severity"),
        target.alias("target_url"),
        (status if status is not None else F.lit(None)).cast("bigint").alias("status_code"),
        (occurrences if occurrences is not None else F.lit(1)).cast("bigint").alias("occurrences"),
        (group if group is not None else F.lit(None)).cast("string").alias("group_id"),
        (F.to_json(F.struct(*[v.alias(k) for k, v in details.items()])) if details else F.lit("{}")).alias("details"),
    )


def with_identity(pages: DataFrame) -> DataFrame:
    """The first row of each URL, with its key; `ordinal` must be there."""
    first = Window.partitionBy("url").orderBy("ordinal")
    return pages.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth").withColumn("key", urls.norm_url(F.col("url")))


def representatives(pages: DataFrame) -> DataFrame:
    """One page for each key: the first that answers 2xx, else the first."""
    best = F.min_by(F.struct("url", "status_code", "indexability", "canonical", "redirect_url", "inlinks", "crawl_depth"), F.struct((~F.coalesce(F.col("status_code").between(200, 299), F.lit(False))).alias("no"), "ordinal"))
    return pages.where("key <> ''").groupBy("key").agg(best.alias("page"))


def value_groups(pages: DataFrame, field: str) -> DataFrame:
    """value, urls (sorted), n: trimmed values that several pages have."""
    value = F.nullif(urls.stripped(F.col(field)), F.lit(""))
    return pages.select(value.alias("value"), "url").where("value is not null").groupBy("value").agg(F.sort_array(F.collect_set("url")).alias("urls"), F.countDistinct("url").alias("n")).where("n > 1")


def duplicates(check: str, field: str) -> Callable[[DataFrame, Settings], DataFrame]:
    def run(pages: DataFrame, s: Settings) -> DataFrame:
        # One row a page, without its group's whole list of URLs: a value that a third of all pages has stays cheap.
        own = pages.where(is_html() & is_indexable()).select("url", F.nullif(urls.stripped(F.col(field)), F.lit("")).alias("value")).where("value is not null")
        sizes = own.groupBy("value").agg(F.countDistinct("url").alias("n")).where("n > 1")
        group = F.concat(F.lit(f"{check}:"), F.substring(F.sha1("value"), 1, 12))
        return found(own.join(sizes, "value"), check, s, F.col("url"), {"value": F.col("value"), "pages": F.col("n")}, group=group)

    return run


def size_stats(pages: DataFrame, size: Column) -> DataFrame:
    """One row: n, median, p75, p90, p95 (linear interpolation), iqr, most."""
    p = F.percentile(size, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95))))
    return pages.where(size.isNotNull()).agg(F.count(F.lit(1)).alias("n"), p.alias("p"), F.max(size).alias("most")).select("n", F.col("p")[1].alias("median"), F.col("p")[2].alias("p75"), F.col("p")[3].alias("p90"), F.col("p")[4].alias("p95"), (F.col("p")[2] - F.col("p")[0]).alias("iqr"), "most")


def large_html(pages: DataFrame, s: Settings) -> DataFrame:
    own = pages.where(is_html() & is_indexable() & F.col("size_bytes").isNotNull()).select("url", "size_bytes", "ordinal")
    stats = size_stats(own, F.col("size_bytes"))
    b = own.crossJoin(F.broadcast(stats))  # of one row
    fence = (F.col("iqr") >= 0.1 * F.col("median")) & (F.col("size_bytes") > F.col("p75") + 1.5 * F.col("iqr"))
    reasons = F.array_compact(F.array(F.when(F.col("size_bytes") > s.threshold("large_html_abs_kb") * 1024, "absolute"), F.when(F.col("size_bytes") > s.threshold("large_html_x_median") * F.col("median"), "median"), F.when(fence, "fence")))
    return found(b.withColumn("reasons", reasons).where(F.size("reasons") > 0), "LARGE_HTML", s, F.col("url"), {"size": F.col("size_bytes"), "median": F.col("median"), "reasons": F.col("reasons")})


def html_bloat(pages: DataFrame, s: Settings) -> DataFrame:
    ratio = F.round(F.col("size_bytes") / F.col("word_count"), 1)
    own = pages.where(is_html() & is_indexable() & (F.col("word_count") > 0) & F.col("size_bytes").isNotNull()).select("url", ratio.alias("ratio"))
    middle = own.agg(F.percentile("ratio", 0.5).alias("median"))
    return found(own.crossJoin(F.broadcast(middle)).where(F.col("ratio") > s.threshold("bytes_per_word_x_median") * F.col("median")), "HTML_BLOAT", s, F.col("url"), {"bytes_per_word": F.col("ratio"), "median": F.col("median")})


#: What separates a site's name from a page's title.
SEPARATORS = (" | ", " - ", " — ", " – ", " · ", " :: ")


def templated_titles(pages: DataFrame, s: Settings) -> DataFrame:
    own = pages.where(is_html() & is_indexable() & ~blank("title")).select(urls.stripped(F.col("title")).alias("title"))
    separator = F.coalesce(*[F.when(F.col("title").contains(x), F.lit(x)) for x in SEPARATORS])
    parts = own.withColumn("separator", separator)
    ends = F.when(F.col("separator").isNotNull(), F.array(F.struct(F.lit("prefix").alias("side"), F.element_at(F.split("title", F.concat(F.lit(r"\Q"), F.col("separator"), F.lit(r"\E"))), 1).alias("token")), F.struct(F.lit("suffix").alias("side"), F.element_at(F.split("title", F.concat(F.lit(r"\Q"), F.col("separator"), F.lit(r"\E"))), -1).alias("token"))))
    counted = parts.select(F.explode(ends).alias("e")).groupBy("e.side", "e.token").agg(F.count(F.lit(1)).alias("n"))
    most = counted.agg(F.max(F.struct("n", "side", "token")).alias("m"))
    total = own.agg(F.count(F.lit(1)).alias("total"))
    b = most.crossJoin(F.broadcast(total)).where((F.col("total") >= 5) & (F.col("m.n") >= s.threshold("templated_title_share") * F.col("total")))
    return found(b, "TITLE_TEMPLATED", s, F.lit(None).cast("string"), {"token": F.col("m.token"), "side": F.col("m.side"), "share": F.bround(F.col("m.n") / F.col("total"), 4)}, occurrences=F.col("m.n"))


def canonical_edges(pages: DataFrame) -> DataFrame:
    """src, dst (keys), url of HTML pages whose canonical is another page."""
    to = urls.norm_url(F.col("canonical"))
    return pages.where(is_html() & ~blank("canonical")).select(F.col("key").alias("src"), to.alias("dst"), "url", "canonical").where("src <> dst and dst <> ''")


def canonical_non_indexable(pages: DataFrame, s: Settings) -> DataFrame:
    variants = pages.groupBy(F.col("key").alias("dst")).agg(F.bool_or(is_indexable()).alias("any"))
    return found(canonical_edges(pages).join(variants, "dst").where("not any"), "CANONICAL_NON_INDEXABLE", s, F.col("url"), {"canonical": F.col("canonical")})


def canonical_to_redirect(pages: DataFrame, s: Settings) -> DataFrame:
    redirects = F.col("status_code").between(300, 399) | ~blank("redirect_url")
    variants = pages.groupBy(F.col("key").alias("dst")).agg(
        F.coalesce(F.bool_or(F.col("status_code").between(200, 299)), F.lit(False)).alias("answers"),
        F.coalesce(F.bool_or(redirects), F.lit(False)).alias("redirects"),
        F.min_by(F.struct("url", "status_code", "redirect_url"), F.when(redirects, F.col("ordinal"))).alias("quoted"),
    )
    b = canonical_edges(pages).join(variants, "dst").where("not answers and redirects")
    return found(b, "CANONICAL_TO_REDIRECT", s, F.col("url"), {"canonical": F.col("canonical"), "target": F.col("quoted.url"), "target_status": F.col("quoted.status_code"), "redirect_url": F.col("quoted.redirect_url")})


def canonical_chains(pages: DataFrame, s: Settings) -> DataFrame:
    edges = canonical_edges(pages)
    onward = edges.select(F.col("src").alias("dst")).distinct()
    starts = edges.join(onward, "dst", "left_semi")
    walked = graph.chains(edges.select("src", "dst"), 8)
    b = starts.select("src", "url", "canonical").join(walked.where("size(path) > 2 or state = 'loop'"), "src")
    return found(b, "CANONICAL_CHAIN", s, F.col("url"), {"path": F.slice("path", 1, 8), "loop": F.col("state") == "loop"})


def unlinked_canonicals(pages: DataFrame, s: Settings) -> DataFrame:
    targets = representatives(pages).where((F.col("page.inlinks") == 0) & ~F.col("page.crawl_depth").eqNullSafe(F.lit(0))).select(F.col("key").alias("dst"), "page.url")
    b = canonical_edges(pages).select("dst", F.col("url").alias("from")).join(targets, "dst").groupBy("url").agg(F.slice(F.sort_array(F.collect_set("from")), 1, 20).alias("sources"), F.countDistinct("from").alias("n"))
    return found(b, "UNLINKED_CANONICAL", s, F.col("url"), {"declared_by": F.col("sources")}, occurrences=F.col("n"))


def redirect_edges(pages: DataFrame) -> DataFrame:
    """Exact URLs, as served."""
    return pages.where(~blank("redirect_url")).select(F.col("url").alias("src"), F.col("redirect_url").alias("dst"))


def redirect_chains(pages: DataFrame, s: Settings) -> DataFrame:
    walked = graph.chains(redirect_edges(pages), int(s.threshold("redirect_hop_cap"))).where("state <> 'loop' and (size(path) > 2)")
    return found(walked, "REDIRECT_CHAIN", s, F.col("src"), {"path": F.col("path"), "hops": F.size("path") - 1, "unresolved": F.col("state") == "capped"})


def redirect_loops(pages: DataFrame, s: Settings) -> DataFrame:
    walked = graph.chains(redirect_edges(pages), int(s.threshold("redirect_hop_cap"))).where("state = 'loop'")
    return found(walked, "REDIRECT_LOOP", s, F.col("src"), {"path": F.col("path")})


def next_edges(pages: DataFrame) -> DataFrame:
    return pages.where(is_html() & ~blank("rel_next")).select(F.col("key").alias("src"), urls.norm_url(F.col("rel_next")).alias("dst")).where("dst <> ''").groupBy("src").agg(F.min("dst").alias("dst"))


def shown_urls(pages: DataFrame) -> DataFrame:
    return representatives(pages).select("key", F.col("page.url").alias("url"))


def pagination_loops(pages: DataFrame, s: Settings) -> DataFrame:
    on = graph.loops(next_edges(pages)).groupBy("loop").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    b = on.join(shown_urls(pages), on.loop == F.col("key"), "left")
    return found(b, "PAGINATION_LOOP", s, F.coalesce("url", "loop"), {"pages": F.col("nodes")}, occurrences=F.size("nodes"))


def unlinked_series(pages: DataFrame, s: Settings) -> DataFrame:
    heads = pages.where(is_indexable() & (F.col("inlinks") == 0) & ~F.col("crawl_depth").eqNullSafe(F.lit(0))).select("key", "url")
    b = graph.series(next_edges(pages)).where("size(path) >= 2").join(heads, F.col("head") == F.col("key"))
    return found(b, "UNLINKED_PAGINATION_SERIES", s, F.col("url"), {"length": F.size("path")})


def pagination_nonindexable(pages: DataFrame, s: Settings) -> DataFrame:
    declares = pages.where(is_html() & ~(blank("rel_next") & blank("rel_prev")))
    own = declares.where(~is_indexable()).select("key", "url", F.lit("declares").alias("why"))
    named = declares.select(F.explode(F.array_compact(F.array("rel_next", "rel_prev"))).alias("to")).select(urls.norm_url(F.col("to")).alias("key")).where("key <> ''").distinct()
    bad = named.join(representatives(pages), "key").where(~F.coalesce(F.col("page.status_code").between(200, 299) & (F.lower(F.trim("page.indexability")) == "indexable"), F.lit(False))).select("key", "page.url", F.lit("named").alias("why"))
    once = own.unionByName(bad).groupBy("key").agg(F.min(F.struct("why", "url")).alias("x"))
    return found(once, "PAGINATION_NONINDEXABLE", s, F.col("x.url"), {"why": F.col("x.why")})


def pagination_sequence(pages: DataFrame, s: Settings) -> DataFrame:
    walked = graph.series(next_edges(pages)).where("size(path) >= 3")
    shown = shown_urls(pages)
    one = walked.select("head", F.posexplode("path").alias("at", "key")).join(shown, "key", "left").select("head", "at", F.coalesce("url", "key").alias("url"), urls.page_number(F.coalesce("url", "key")).alias("number"))
    order = Window.partitionBy("head").orderBy("at")
    steps = one.withColumn("step", F.col("number") - F.lag("number").over(order))
    judged = steps.groupBy("head").agg(F.bool_and(F.col("number").isNotNull()).alias("stated"), F.bool_or(F.col("step") == 1).alias("counts"), F.sort_array(F.collect_list(F.when((F.col("step") != 1), F.struct("at", "url", "step")))).alias("wrong"), F.min_by("url", "at").alias("url"))
    return found(judged.where("stated and counts and size(wrong) > 0"), "PAGINATION_SEQUENCE_ERROR", s, F.col("url"), {"steps": F.col("wrong")}, occurrences=F.size("wrong"))


def duplicate_hashes(pages: DataFrame, s: Settings) -> DataFrame:
    return duplicates("DUPLICATE_BY_HASH", "hash")(pages, s)


GROUP_CHECKS: dict[str, Callable[[DataFrame, Settings], DataFrame]] = {
    "TITLE_DUPLICATE": duplicates("TITLE_DUPLICATE", "title"),
    "DESC_DUPLICATE": duplicates("DESC_DUPLICATE", "meta_description"),
    "H1_DUPLICATE": duplicates("H1_DUPLICATE", "h1"),
    "H2_DUPLICATE": duplicates("H2_DUPLICATE", "h2"),
    "DUPLICATE_BY_HASH": duplicate_hashes,
    "LARGE_HTML": large_html,
    "HTML_BLOAT": html_bloat,
    "TITLE_TEMPLATED": templated_titles,
    "CANONICAL_NON_INDEXABLE": canonical_non_indexable,
    "CANONICAL_TO_REDIRECT": canonical_to_redirect,
    "CANONICAL_CHAIN": canonical_chains,
    "UNLINKED_CANONICAL": unlinked_canonicals,
    "REDIRECT_CHAIN": redirect_chains,
    "REDIRECT_LOOP": redirect_loops,
    "PAGINATION_LOOP": pagination_loops,
    "UNLINKED_PAGINATION_SERIES": unlinked_series,
    "PAGINATION_NONINDEXABLE": pagination_nonindexable,
    "PAGINATION_SEQUENCE_ERROR": pagination_sequence,
}
