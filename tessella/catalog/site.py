"""Queries over what a crawl may fetch and what its resources and rendered documents show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog.base import Query, table
from tessella.functions import assets
from tessella.operators import scope
from tessella.plans import rendering

RULES = scope.Scope("www.example.com", exclude_hosts=("example.org",), exclude_patterns=(r"[?&]utm_", r"/page/\d+"), include_patterns=(r"/[a-m]", r"\d"))


def scope_rejections(spark: SparkSession, d: str) -> DataFrame:
    """Addresses made of customers' names and keys, on several hosts."""
    k = F.col("c_custkey")
    host = F.when(k % 5 == 0, "www.example.com").when(k % 5 == 1, "WWW.Example.com").when(k % 5 == 2, "shop.example.com").when(k % 5 == 3, "cdn.example.org").otherwise("www.example.com")
    query = F.when(k % 7 == 0, "?utm_source=x").when(k % 7 == 1, "?q=1").otherwise("")
    path = F.when(k % 11 == 0, F.concat(F.lit("/page/"), k.cast("string"))).when(k % 3 == 0, F.lit("/zone")).otherwise(F.concat(F.lit("/"), F.lower(F.col("c_mktsegment"))))
    url = F.concat(F.lit("https://"), host, path, query)
    return table(spark, d, "customer").select(F.col("c_custkey"), scope.rejection(url, RULES).alias("rejected_by"))


SCOPE_REJECTIONS = r"""
WITH a AS (
  SELECT c_custkey, c_custkey % 5 AS h,
    CASE WHEN c_custkey % 11 = 0 THEN '/page/' || CAST(c_custkey AS VARCHAR) WHEN c_custkey % 3 = 0 THEN '/zone' ELSE '/' || lower(c_mktsegment) END || CASE c_custkey % 7 WHEN 0 THEN '?utm_source=x' WHEN 1 THEN '?q=1' ELSE '' END AS rest
  FROM customer)
SELECT c_custkey, CASE WHEN h IN (2, 3) THEN 'outside_host' WHEN contains(rest, '?utm_') OR regexp_matches(rest, '/page/\d+') THEN 'excluded_by_pattern'
  WHEN NOT (regexp_matches(rest, '/[a-m]') OR regexp_matches(rest, '\d')) AND NOT regexp_matches(CASE h WHEN 1 THEN 'https://WWW.Example.com' ELSE 'https://www.example.com' END || rest, '/[a-m]|\d') THEN 'not_included_by_pattern' ELSE '' END AS rejected_by
FROM a
"""


def asset_texts(spark: SparkSession, d: str) -> DataFrame:
    """Scripts and style sheets made of orders: each with the marks of some problems."""
    k = F.col("o_orderkey")
    text = F.concat(
        F.when(k % 2 == 0, "var a=1;console.log(a);").otherwise("let b = 2;\n  let c = 3;\n"),
        F.when(k % 3 == 0, "document.write('x');").otherwise(""),
        F.when(k % 5 == 0, "_babelPolyfill();").otherwise(""),
        F.when(k % 7 == 0, "@font-face{src:url(a)}").when(k % 7 == 1, "@font-face{font-display: swap}").otherwise(""),
        F.when(k % 11 == 0, "@import url('m.css');").otherwise(""),
        F.when(k % 13 == 0, F.concat(F.lit("//# sourceMappingURL=app"), (k % 4).cast("string"), F.lit(".js.map"))).when(k % 13 == 1, "//# sourceMappingURL=data:x").otherwise(""),
    )
    cache = F.when(k % 4 == 0, "no-store").when(k % 4 == 1, "max-age=60").when(k % 4 == 2, "public, max-age=604800")
    encoding = F.when(k % 3 == 0, "gzip").when(k % 3 == 1, "identity")
    return table(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("https://x/"), k.cast("string")).alias("url"), F.lit("js").alias("kind"), F.lit(True).alias("ok"), text.alias("text"), cache.alias("cache"), encoding.alias("encoding"))


def asset_findings(spark: SparkSession, d: str) -> DataFrame:
    t, life = F.col("text"), assets.cache_verdict(F.col("cache"))
    return asset_texts(spark, d).select(
        "id", assets.legacy_script(t).alias("legacy"), assets.document_write(t).alias("writes"), F.array_join(assets.debug_code(t), " ").alias("debug"), assets.source_map(t).alias("map"),
        F.size(assets.fonts_without_display(t)).cast("bigint").alias("fonts"), F.array_join(assets.css_imports(t), " ").alias("imports"), life["ok"].alias("kept_long"), life["max_age"].alias("max_age"), assets.compressed(F.col("encoding")).alias("compressed"),
    )


ASSET_FINDINGS = """
SELECT o_orderkey AS id, o_orderkey % 5 = 0 AS legacy, o_orderkey % 3 = 0 AS writes, CASE WHEN o_orderkey % 2 = 0 THEN 'console.log(' ELSE '' END AS debug,
  CASE WHEN o_orderkey % 13 = 0 THEN 'app' || CAST(o_orderkey % 4 AS VARCHAR) || '.js.map' END AS map, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS fonts,
  CASE WHEN o_orderkey % 11 = 0 THEN 'm.css' ELSE '' END AS imports, o_orderkey % 4 = 2 AS kept_long, CAST(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 60 WHEN 2 THEN 604800 END AS BIGINT) AS max_age, o_orderkey % 3 = 0 AS compressed
FROM orders
"""


def duplicate_libraries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as scripts: the same words at several addresses."""
    rows = table(spark, d, "documents").select(F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("kind"), F.lit(True).alias("ok"), "text")
    return assets.duplicate_libraries(rows).groupBy("kind", "hash", "addresses").agg(F.min("url").alias("first_url"))


DUPLICATE_LIBRARIES = r"""
SELECT coalesce(lang, '') AS kind, sha256(regexp_replace(text, '\s+', '', 'g')) AS hash, count(DISTINCT doc_id) AS addresses, min('https://x/' || CAST(doc_id AS VARCHAR)) AS first_url
FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 1
"""


def render_differences(spark: SparkSession, d: str) -> DataFrame:
    """Parts as pages: their facts before and after scripts."""
    k = F.col("p_partkey")
    types = lambda c: F.when(c, F.array(F.lit("Product"), F.lit("Offer"))).otherwise(F.array(F.lit("Product")))
    p = table(spark, d, "part").withColumn("url", k.cast("string"))
    raw = p.select("url", (k % 300).cast("bigint").alias("words"), (k % 10).cast("bigint").alias("links"), F.array().cast("array<string>").alias("images"), F.col("p_name").alias("title"), F.lit("h").alias("h1"), F.lit("/c").alias("canonical"), types(k % 4 == 0).alias("jsonld_types"), F.lit(1000).cast("bigint").alias("html_bytes"), F.when(k % 17 == 0, "app").alias("shell"))
    lost = k % 19 == 0
    rendered = p.select(
        "url", (k % 300 + k % 90).cast("bigint").alias("words"), F.when(lost, 0).otherwise(k % 10 + k % 5).cast("bigint").alias("links"), F.when(k % 6 == 0, F.array(F.lit("a.png"))).otherwise(F.array().cast("array<string>")).alias("images"),
        F.when(lost, "").when(k % 8 == 0, "other").otherwise(F.col("p_name")).alias("title"), F.when(lost, "").when(k % 9 == 0, "g").otherwise("h").alias("h1"), F.when(lost, "").when(k % 10 == 0, "/d").otherwise("/c").alias("canonical"),
        types((k % 4 == 0) | (k % 7 == 0)).alias("jsonld_types"), F.when(lost, 100).otherwise(1200).cast("bigint").alias("html_bytes"),
    )
    return rendering.compared(raw, rendered).select("url", F.array_join("findings", " ").alias("findings"), F.array_join("types_added", " ").alias("added"))


RENDER_DIFFERENCES = """
WITH f AS (
  SELECT CAST(p_partkey AS VARCHAR) AS url, p_partkey AS k, p_partkey % 300 AS rw, p_partkey % 300 + p_partkey % 90 AS dw, p_partkey % 10 AS rl,
         CASE WHEN p_partkey % 19 = 0 THEN 0 ELSE p_partkey % 10 + p_partkey % 5 END AS dl, p_partkey % 17 = 0 AS shell, p_partkey % 19 = 0 AS lost, p_partkey % 7 = 0 AND p_partkey % 4 <> 0 AS typed FROM part),
c AS (
  SELECT *, array_to_string(list_filter([
    CASE WHEN shell THEN 'empty_shell' END, CASE WHEN NOT shell AND rw < 50 AND dw > 50 THEN 'no_copy_in_response' END, CASE WHEN rw >= 50 AND dw > rw AND (dw - rw) / dw >= 0.3 THEN 'copy_after_scripts' END,
    CASE WHEN dl > rl AND ((dl - rl) / dl >= 0.3 OR rl = 0) THEN 'links_after_scripts' END, CASE WHEN lost OR k % 8 = 0 THEN 'title_changes' END, CASE WHEN NOT lost AND k % 9 = 0 THEN 'h1_differs' END,
    CASE WHEN lost OR k % 10 = 0 THEN 'canonical_changes' END, CASE WHEN typed THEN 'types_after_scripts' END, CASE WHEN k % 6 = 0 THEN 'images_after_scripts' END], lambda x: x IS NOT NULL), ' ') AS every FROM f)
SELECT url, CASE WHEN lost THEN 'render_unavailable' || CASE WHEN shell THEN ' empty_shell' ELSE '' END WHEN every = '' THEN 'all_clear' ELSE every END AS findings, CASE WHEN typed THEN 'Offer' ELSE '' END AS added FROM c
"""

QUERIES = (
    Query("scope_rejections", scope_rejections, SCOPE_REJECTIONS),
    Query("asset_findings", asset_findings, ASSET_FINDINGS),
    Query("duplicate_libraries", duplicate_libraries, DUPLICATE_LIBRARIES),
    Query("render_differences", render_differences, RENDER_DIFFERENCES),
)
