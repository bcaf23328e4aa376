"""Queries that join and compare relations: external rows, sitemaps, language versions, periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog.base import Query, table
from tessella.functions import urls
from tessella.operators import joins, periods
from tessella.plans import compare


def external_rows(spark: SparkSession, d: str) -> DataFrame:
    """URL-keyed rows as another tool might export them: some of the pages under other spellings, some unknown, some without a URL."""
    p = table(spark, d, "pages")
    own = p.where("page_id % 3 = 0").select(F.concat(F.upper(urls.scheme(F.col("url"))), F.lit("://"), F.upper(urls.host(F.col("url"))), urls.path(F.col("url")), F.when(urls.query(F.col("url")) != "", F.concat(F.lit("?"), urls.query(F.col("url")))).otherwise("")).alias("url"), F.col("page_id").alias("clicks"))
    unknown = p.where("page_id % 10 = 1").select(F.concat(F.lit("https://unknown.example/"), F.col("page_id").cast("string")).alias("url"), F.col("page_id").alias("clicks"))
    return own.unionByName(unknown).unionByName(p.where("page_id % 50 = 2").select(F.lit("not a url").alias("url"), F.col("page_id").alias("clicks")))


def external_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.external_join(table(spark, d, "pages").select("page_id", "url"), external_rows(spark, d)).summary()


KEYED = r"""
keyed AS (
  SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) ||
    CASE WHEN length(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) > 1 THEN regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) END ||
    CASE WHEN regexp_extract(url, '\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '\?([^#]*)', 1) ELSE '' END AS key
  FROM pages)"""
EXTERNAL_JOIN = f"""
WITH {KEYED},
ext AS (SELECT key FROM keyed WHERE page_id % 3 = 0 UNION ALL SELECT 'https://unknown.example/' || CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 10 = 1)
SELECT 'joined' AS part, count(*) AS rows FROM keyed JOIN ext ON keyed.key = ext.key
UNION ALL SELECT 'crawl_only', count(*) FROM keyed WHERE key NOT IN (SELECT key FROM ext)
UNION ALL SELECT 'external_only', count(*) FROM ext WHERE key NOT IN (SELECT key FROM keyed)
UNION ALL SELECT 'unkeyable_pages', count(*) FROM pages WHERE FALSE
UNION ALL SELECT 'unkeyable_rows', count(*) FROM pages WHERE page_id % 50 = 2
"""


def labelled_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with, without, and labels without a document, by source."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    both = docs.select("doc_id", "source").join(labels, "doc_id", "full_outer")
    return both.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("quality").alias("labelled"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("bigint").alias("toxic"))


LABELLED = """
SELECT coalesce(d.source, 'none') AS source, count(l.quality) AS labelled, count(*) FILTER (l.quality IS NULL) AS unlabelled, CAST(coalesce(sum(l.toxic), 0) AS BIGINT) AS toxic
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1
"""


def reconciled(spark: SparkSession, d: str) -> DataFrame:
    """A sitemap that declares two thirds of the pages, and links to three quarters of them."""
    p = table(spark, d, "pages")
    declared = p.where("page_id % 3 <> 0").select(F.col("url").alias("loc"))
    links = p.where("page_id % 4 <> 0").select(F.col("url").alias("destination"))
    return joins.reconcile(declared, p.select("url", (F.col("page_id") % 5 != 0).alias("comparable")), links).groupBy("state").agg(F.count(F.lit(1)).alias("urls"))


RECONCILED = f"""
WITH {KEYED},
own AS (SELECT key, bool_or(page_id % 5 <> 0) AS comparable, bool_or(page_id % 3 <> 0) AS declared, bool_or(page_id % 4 <> 0) AS linked FROM keyed GROUP BY key)
SELECT CASE WHEN declared AND linked THEN 'healthy' WHEN declared THEN 'orphan' WHEN comparable THEN 'missing' ELSE 'linked_not_comparable' END AS state, count(*) AS urls
FROM own WHERE declared OR linked GROUP BY 1
"""


def languages(spark: SparkSession, d: str) -> DataFrame:
    """Nations declare those of the next region as language versions; a third of the pages was not read."""
    n = table(spark, d, "nation")
    page = lambda k: F.concat(F.lit("https://site.example/"), k.cast("string"))
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("r")), n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("r"))
    tags = a.join(b, "r").where("(a + b) % 3 <> 1").select(page(F.col("a")).alias("source_url"), page(F.col("b")).alias("destination_url"), F.when(F.expr("b % 4 = 0"), "x-default").otherwise("en").alias("hreflang"))
    return joins.language_states(n.select(page(F.col("n_nationkey")).alias("url"), (F.col("n_nationkey") % 3 != 2).alias("measured")), tags)


LANGUAGES = """
WITH tags AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN b.n_nationkey % 4 = 0 THEN 'x-default' ELSE 'en' END AS code FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE (a.n_nationkey + b.n_nationkey) % 3 <> 1),
judged AS (SELECT a, bool_or(a = b) AS s, bool_or(code = 'x-default') AS x, bool_and(EXISTS (SELECT 1 FROM tags t WHERE t.a = tags.b AND t.b = tags.a)) AS r FROM tags GROUP BY a)
SELECT 'https://site.example/' || CAST(n_nationkey AS VARCHAR) AS url,
  CASE WHEN n_nationkey % 3 = 2 THEN 'unmeasured' WHEN coalesce(s, FALSE) THEN 'present' ELSE 'missing' END AS self_reference,
  CASE WHEN n_nationkey % 3 = 2 THEN 'unmeasured' WHEN coalesce(x, FALSE) THEN 'present' ELSE 'missing' END AS x_default,
  CASE WHEN n_nationkey % 3 = 2 THEN 'unmeasured' WHEN coalesce(r, FALSE) THEN 'present' ELSE 'missing' END AS reciprocity
FROM nation LEFT JOIN judged ON n_nationkey = a
"""


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """What users did in the first half of January that they didn't in the second, and the other way round."""
    e = table(spark, d, "events").select("user_id", "event_type", F.dayofmonth("ts").alias("day"))
    return compare.evidence_difference(e.where("day <= 15"), e.where("day > 15"), ["user_id", "event_type"])


EVIDENCE = """
WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE day(ts) <= 15), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE day(ts) > 15)
SELECT user_id, event_type, 'first' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT user_id, event_type, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
"""


def body_changes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("url"), F.lit("a").alias("variant"), F.col("lang").alias("representation"), "doc_id", "text")
    before = docs.where("doc_id % 5 <> 0").select("url", "variant", "representation", F.when(F.expr("doc_id % 11 <> 0"), F.sha2("text", 256)).alias("sha256"))
    after = docs.where("doc_id % 7 <> 0").select("url", "variant", "representation", F.sha2(F.when(F.expr("doc_id % 3 = 0"), F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return compare.body_diff(before, after).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


BODY_CHANGES = """
SELECT CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'not_comparable' WHEN doc_id % 11 = 0 THEN 'missing_evidence' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS state, count(*) AS n
FROM documents WHERE NOT (doc_id % 5 = 0 AND doc_id % 7 = 0) GROUP BY 1
"""

END = "2024-01-31"


def period_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Orders of the last quarter by priority against the quarter before."""
    o = table(spark, d, "orders").select("o_orderdate", "o_orderpriority", F.lit(1).cast("bigint").alias("one"))
    last = o.agg(F.to_date(F.max("o_orderdate")).cast("string")).first()[0]
    return periods.breakdown(o, "o_orderdate", "o_orderpriority", "one", last, 3, shown=3)


PERIOD_BREAKDOWN = """
WITH e AS (SELECT CAST(max(o_orderdate) AS DATE) AS last FROM orders),
w AS (SELECT last, CAST(last - INTERVAL 3 MONTH + INTERVAL 1 DAY AS DATE) AS start FROM e),
w2 AS (SELECT last, start, CAST(start - INTERVAL 1 DAY AS DATE) AS last2, start - CAST(last - start + 1 AS INTEGER) AS start2 FROM w),
s AS (SELECT o_orderpriority AS dim, count(*) FILTER (CAST(o_orderdate AS DATE) BETWEEN start AND last) AS n, count(*) FILTER (CAST(o_orderdate AS DATE) BETWEEN start2 AND last2) AS b FROM orders, w2 GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, dim) AS k FROM s),
f AS (SELECT CASE WHEN k <= 3 THEN dim ELSE 'other' END AS dimension, CAST(sum(n) AS BIGINT) AS now, CAST(sum(b) AS BIGINT) AS before FROM k GROUP BY 1)
SELECT dimension, now, before, round(now / (SELECT sum(now) FROM f) * 100, 2) AS share, CASE WHEN before <> 0 THEN round((now - before) / before * 100, 2) END AS change,
  CASE WHEN (SELECT sum(before) FROM f) = 0 THEN 'no_baseline' WHEN before = 0 THEN 'new' ELSE 'ok' END AS status FROM f
"""


def aligned_days(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("ts", F.lit(1).cast("bigint").alias("one"))
    last = e.agg(F.to_date(F.max("ts")).cast("string")).first()[0]
    return periods.aligned_days(e, "ts", "one", last, 1).select("at", F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("before", F.lit(0)).alias("before"))


ALIGNED = """
WITH e AS (SELECT CAST(max(ts) AS DATE) AS last FROM events), w AS (SELECT last, CAST(last - INTERVAL 1 MONTH + INTERVAL 1 DAY AS DATE) AS start FROM e),
days AS (SELECT range AS k, w.start + CAST(range AS INTEGER) AS day, w.start - CAST(w.last - w.start + 1 AS INTEGER) + CAST(range AS INTEGER) AS day2 FROM w, range(0, 31) WHERE range <= w.last - w.start),
n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(k AS INTEGER) AS "at", coalesce(a.n, 0) AS now, coalesce(b.n, 0) AS before FROM days LEFT JOIN n a ON days.day = a.day LEFT JOIN n b ON days.day2 = b.day
"""


def spend(spark: SparkSession, d: str) -> DataFrame:
    """Orders as spending of customers' segments."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.col("c_mktsegment").alias("source"), F.col("o_orderpriority").alias("operation"), F.trunc("o_orderdate", "year").alias("at"), F.lit("credits").alias("unit"), F.round("o_totalprice").cast("bigint").alias("amount"), (F.col("o_orderstatus") == "F").alias("measured"))
    return periods.spend(rows).select("dimension", "value", "unit", F.col("measured").cast("bigint").alias("measured"), F.col("uncertain").cast("bigint").alias("uncertain"))


SPEND = """
WITH r AS (SELECT c_mktsegment AS source, o_orderpriority AS operation, CAST(CAST(date_trunc('year', o_orderdate) AS DATE) AS VARCHAR) AS day, 'credits' AS unit, CAST(round(o_totalprice) AS BIGINT) AS amount, o_orderstatus = 'F' AS measured FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'source' AS dimension, source AS value, unit, CAST(coalesce(sum(amount) FILTER (measured), 0) AS BIGINT) AS measured, CAST(coalesce(sum(amount) FILTER (NOT measured), 0) AS BIGINT) AS uncertain FROM r GROUP BY source, unit
UNION ALL SELECT 'operation', operation, unit, CAST(coalesce(sum(amount) FILTER (measured), 0) AS BIGINT), CAST(coalesce(sum(amount) FILTER (NOT measured), 0) AS BIGINT) FROM r GROUP BY operation, unit
UNION ALL SELECT 'day', day, unit, CAST(coalesce(sum(amount) FILTER (measured), 0) AS BIGINT), CAST(coalesce(sum(amount) FILTER (NOT measured), 0) AS BIGINT) FROM r GROUP BY day, unit
"""

QUERIES = (
    Query("external_join", external_join, EXTERNAL_JOIN),
    Query("labelled_documents", labelled_documents, LABELLED),
    Query("sitemap_reconcile", reconciled, RECONCILED),
    Query("language_states", languages, LANGUAGES),
    Query("evidence_difference", evidence, EVIDENCE),
    Query("body_changes", body_changes, BODY_CHANGES),
    Query("period_breakdown", period_breakdown, PERIOD_BREAKDOWN),
    Query("aligned_days", aligned_days, ALIGNED),
    Query("spend_rollup", spend, SPEND),
)
