"""Queries over crawled pages: URL identities, checks, audits, segments, parsed markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog.base import Query, table
from tessella.functions import html, scores, urls, values
from tessella.operators import rollups
from tessella.operators.shared import written
from tessella.plans import compare, page_checks, segments, tasks
from tessella.plans.audit import Audit, run_audit, site_of
from tessella.plans.settings import Settings
from tessella.sources import robots

PARSED = ["title", "h1", "h1_2", "h2", "meta_description", "meta_charset", "doctype", "viewport", "canonical", "lang", "word_count", "text_ratio", "heading_outline", "link_placement", "head_count", "body_count", "head_not_first", "images_total", "images_missing_alt_attr", "dom_depth", "dom_nodes", "outlinks", "external_outlinks", "lorem_ipsum_count", "structured_data", "structured_data_parsed"]
URL_CHECKS = ("URL_TOO_LONG", "URL_HAS_PARAMS", "URL_NON_ASCII", "URL_UPPERCASE", "HTTP_URL", "URL_UNDERSCORES", "URL_MULTIPLE_SLASHES", "URL_CONTAINS_SPACE", "URL_REPETITIVE_PATH", "URL_TRACKING_PARAMS")
PARTS = r"""
parts AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host,
         regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment
  FROM pages)"""


def crawled(spark: SparkSession, d: str) -> DataFrame:
    """The pages as a crawl that was answered everywhere."""
    return table(spark, d, "pages").select("page_id", "url", "html", F.lit("text/html").alias("content_type"), F.lit(200).alias("status_code"), F.lit("Indexable").alias("indexability"), F.col("page_id").alias("ordinal"))


def url_identities(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.norm_url(u).alias("norm_key"), urls.sitemap_key(u).alias("sitemap_key"), urls.crawl_key(u).alias("crawl_key"), urls.join_key(u, ignore_query=True, ignore_scheme=True).alias("loose_key"), urls.host(u).alias("host"), urls.strip_www(urls.host(u)).alias("bare_host"), urls.redirect_path(u).alias("redirect_path"), urls.section(urls.path(u)).alias("section"), urls.url_kind(u).alias("kind"))


URL_IDENTITIES = f"""
WITH {PARTS}
SELECT page_id,
  scheme || '://' || host || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END AS norm_key,
  scheme || '://' || host || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS sitemap_key,
  scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS crawl_key,
  'https://' || host || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END AS loose_key,
  host, regexp_replace(host, '^www\\.', '') AS bare_host, regexp_replace(url, '^https?://[^/]+', '') AS redirect_path,
  CASE WHEN regexp_extract(path, '^/?([^/]+)', 1) = '' THEN '/' ELSE '/' || regexp_extract(path, '^/?([^/]+)', 1) END AS section,
  CASE WHEN regexp_extract(path, '([^/]*)/*$', 1) LIKE '%.%' THEN 'finalUrl' ELSE 'folder' END AS kind
FROM parts
"""


def url_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The first two pages of each URL pattern, and how many there are."""
    rows = table(spark, d, "pages").select("page_id", "url", urls.url_pattern(F.col("url")).alias("pattern"))
    n = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return rollups.top(rows, ["pattern"], [F.col("page_id")], 2).join(n, "pattern").select("pattern", "page_id", "n")


URL_PATTERNS = f"""
WITH {PARTS},
named AS (
  SELECT page_id, scheme || '://' || regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) ||
    array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_matches(s, '^(\\d+|\\d{{4}}-\\d{{2}}-\\d{{2}})$') THEN '*' WHEN regexp_matches(s, '^[\\w-]{{9,}}$') AND s <> string_split(path, '/')[2] THEN '*' ELSE s END), '/') AS pattern FROM parts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY page_id) AS k, count(*) OVER (PARTITION BY pattern) AS n FROM named)
SELECT pattern, page_id, n FROM ranked WHERE k <= 2
"""


def parameters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_join(urls.parameters(F.col("url")), ",").alias("names"), F.array_join(urls.tracking_parameters(F.col("url")), ",").alias("tracking"), urls.page_number(F.col("url")).cast("bigint").alias("page_number"))


PARAMETERS = f"""
WITH {PARTS},
named AS (SELECT page_id, list_transform(list_filter(string_split(query, '&'), lambda p: regexp_matches(p, '^[^=]+=.+')), lambda p: regexp_extract(p, '^([^=]*)', 1)) AS names, query, path FROM parts)
SELECT page_id, array_to_string(names, ',') AS names, array_to_string(list_filter(names, lambda p: regexp_matches(p, '^(utm_[a-z_]+|gclid|fbclid)$')), ',') AS tracking,
       TRY_CAST(nullif(regexp_extract(query, '(?:^|&)page=(\\d+)', 1), '') AS BIGINT) AS page_number
FROM named
"""


def host_policy(spark: SparkSession, d: str) -> DataFrame:
    return rollups.host_policy(table(spark, d, "pages").select(urls.host(F.col("url")).alias("host")))


HOST_POLICY = f"""
WITH {PARTS}
SELECT count(*) FILTER (host LIKE 'www.%') AS www, count(*) FILTER (host NOT LIKE 'www.%') AS non_www,
       CASE WHEN count(*) FILTER (host LIKE 'www.%') >= count(*) FILTER (host NOT LIKE 'www.%') THEN 'www' ELSE 'non_www' END AS dominant,
       count(*) FILTER (host LIKE 'www.%') > 0 AND count(*) FILTER (host NOT LIKE 'www.%') > 0 AS mixed
FROM parts
"""


def url_findings(spark: SparkSession, d: str) -> DataFrame:
    site = site_of(crawled(spark, d).drop("html", "page_id"))
    return page_checks.findings(site.pages, Settings(), list(URL_CHECKS)).select("check", "severity", "target_url")


URL_FINDINGS = f"""
WITH {PARTS},
first AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url),
own AS (SELECT p.* FROM parts p JOIN first f ON p.page_id = f.page_id),
named AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '' AND NOT regexp_matches(s, '^\\d+$')) AS segments FROM own)
SELECT 'URL_TOO_LONG' AS "check", 'notice' AS severity, url AS target_url FROM own WHERE length(url) > 115
UNION ALL SELECT 'URL_HAS_PARAMS', 'notice', url FROM own WHERE contains(url, '?')
UNION ALL SELECT 'URL_NON_ASCII', 'notice', url FROM own WHERE regexp_matches(path, '[^\\x00-\\x7F]')
UNION ALL SELECT 'URL_UPPERCASE', 'notice', url FROM own WHERE path <> lower(path)
UNION ALL SELECT 'HTTP_URL', 'warning', url FROM own WHERE url LIKE 'http://%'
UNION ALL SELECT 'URL_UNDERSCORES', 'notice', url FROM own WHERE contains(path, '_')
UNION ALL SELECT 'URL_MULTIPLE_SLASHES', 'notice', url FROM own WHERE contains(path, '//')
UNION ALL SELECT 'URL_CONTAINS_SPACE', 'warning', url FROM own WHERE contains(url, ' ') OR contains(url, '%20')
UNION ALL SELECT 'URL_REPETITIVE_PATH', 'notice', url FROM named WHERE len(segments) >= 2 AND len(segments) <> len(list_distinct(segments))
UNION ALL SELECT 'URL_TRACKING_PARAMS', 'warning', url FROM own WHERE regexp_matches(query, '(^|&)(utm_[a-z_]+|gclid|fbclid)=[^&]')
"""


def markup(spark: SparkSession, d: str) -> DataFrame:
    """What regular expressions can read from this markup as well."""
    read = html.parsed_pages(table(spark, d, "pages"), ["title", "title_count", "meta_charset", "lang", "doctype", "head_count", "body_count"])
    return read.select("url", "title", F.col("title_count").cast("bigint").alias("title_count"), "meta_charset", "lang", "doctype", F.col("head_count").cast("bigint").alias("head_count"), F.col("body_count").cast("bigint").alias("body_count"))


MARKUP = r"""
SELECT url,
  nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title,
  len(regexp_extract_all(html, '<title>')) AS title_count, nullif(regexp_extract(html, '<meta charset="([^"]*)"', 1), '') AS meta_charset, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang,
  nullif(trim(regexp_extract(html, '(?i)<!doctype([^>]*)>', 1)), '') AS doctype, len(regexp_extract_all(html, '<head>')) AS head_count, len(regexp_extract_all(html, '<body>')) AS body_count
FROM pages
"""


ANSWERED = {"content_type": "text/html", "status_code": 200, "indexability": "Indexable"}


def parsed_site(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The pages as a crawl that was answered everywhere, each parsed once."""
    pages = table(spark, d, "pages").select("url", F.col("page_id").alias("ordinal"), F.octet_length("html").cast("bigint").alias("size_bytes"), "html")
    return html.parsed_pages(pages, [*PARSED, *more], ("ordinal", "size_bytes")).withColumns({k: F.lit(v) for k, v in ANSWERED.items()})


def audit(spark: SparkSession, d: str) -> Audit:
    """One pass of the parser, whose result is written down for the checks."""
    read = written(parsed_site(spark, d, "links"), "parsed-pages")
    return run_audit(site_of(read.drop("links"), {"links": html.link_rows(read)}, host=None), Settings())


def audit_by_check(spark: SparkSession, d: str) -> DataFrame:
    return run_audit(site_of(parsed_site(spark, d)), Settings()).by_check()


def audit_statuses(spark: SparkSession, d: str) -> DataFrame:
    """What became of every registered check when only URLs and statuses were measured."""
    return run_audit(site_of(crawled(spark, d).drop("html", "page_id")), Settings()).statuses.select("check", "severity", "state")


def audit_score(spark: SparkSession, d: str) -> DataFrame:
    own = Settings({"checks": {}})
    a = run_audit(site_of(crawled(spark, d).drop("html", "page_id")), own)
    return a.score()


def task_list(spark: SparkSession, d: str) -> DataFrame:
    found = url_findings(spark, d).withColumns({"occurrences": F.lit(1).cast("bigint"), "status_code": F.lit(200)})
    return tasks.tasks(found, Settings()).select("key", "severity", "priority", "effort", "affected", "occurrences", F.array_join("urls", " ").alias("urls"), F.col("more").cast("bigint").alias("more"))


TASK_LIST = f"""
WITH found AS ({URL_FINDINGS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY target_url) AS k FROM (SELECT DISTINCT * FROM found)),
whole AS (SELECT "check", severity, count(DISTINCT target_url) AS affected, count(*) AS occurrences FROM found GROUP BY "check", severity),
shown AS (SELECT "check", string_agg(target_url, ' ' ORDER BY target_url) AS urls FROM ranked WHERE k <= 25 GROUP BY "check")
SELECT w."check" AS key, w.severity, CASE w.severity WHEN 'critical' THEN 'P1' WHEN 'warning' THEN 'P2' ELSE 'P3' END AS priority,
       CASE w.severity WHEN 'critical' THEN 'high' WHEN 'warning' THEN 'medium' ELSE 'low' END AS effort, w.affected, w.occurrences, s.urls, greatest(w.affected - 25, 0) AS more
FROM whole w JOIN shown s ON w."check" = s."check"
"""


def compared_audits(spark: SparkSession, d: str) -> DataFrame:
    """The findings of two crawls: one without every seventh page, one without every fifth."""
    every = table(spark, d, "pages").select("url", "page_id")
    before, after = every.where("page_id % 7 <> 0"), every.where("page_id % 5 <> 0")
    found = url_findings(spark, d)
    return compare.compared(found.join(before, found.target_url == before.url, "left_semi"), found.join(after, found.target_url == after.url, "left_semi").where("not (check = 'HTTP_URL' and length(target_url) % 3 = 0)"), before, after)


COMPARED = f"""
WITH found AS ({URL_FINDINGS}),
before_urls AS (SELECT DISTINCT url FROM pages WHERE page_id % 7 <> 0), after_urls AS (SELECT DISTINCT url FROM pages WHERE page_id % 5 <> 0),
b AS (SELECT DISTINCT "check", target_url FROM found WHERE target_url IN (SELECT url FROM before_urls)),
a AS (SELECT DISTINCT "check", target_url FROM found WHERE target_url IN (SELECT url FROM after_urls) AND NOT ("check" = 'HTTP_URL' AND length(target_url) % 3 = 0)),
joint AS (SELECT coalesce(b."check", a."check") AS "check", coalesce(b.target_url, a.target_url) AS target_url, b."check" IS NOT NULL AS was, a."check" IS NOT NULL AS now FROM b FULL OUTER JOIN a ON b."check" = a."check" AND b.target_url = a.target_url)
SELECT "check", target_url, CASE WHEN was AND now THEN 'persisted' WHEN NOT was THEN CASE WHEN target_url IN (SELECT url FROM before_urls) THEN 'appeared' ELSE 'entered' END ELSE CASE WHEN target_url IN (SELECT url FROM after_urls) THEN 'disappeared' ELSE 'left' END END AS change
FROM joint
"""

SEGMENTS = [
    segments.Segment("campaign", (segments.Rule("url", "contains", "utm_source"),)),
    segments.Segment("secure_campaign", (segments.Rule("base", "segment", "campaign"), segments.Rule("url", "prefix", "https://"))),
    segments.Segment("en", (segments.Rule("path", "prefix", "/en/"),)),
    segments.Segment("european", (segments.Rule("path", "regex", "^/(de|fr|es)/"),)),
]


def segment_report(spark: SparkSession, d: str) -> DataFrame:
    pages = segments.segmented(table(spark, d, "pages").select("url"), SEGMENTS)
    return segments.report(pages, url_findings(spark, d))


SEGMENT_REPORT = f"""
WITH found AS ({URL_FINDINGS}),
placed AS (
  SELECT url, CASE WHEN contains(url, 'utm_source') THEN 'campaign' WHEN regexp_matches(url, '^[a-z]+://[^/]*/en/') THEN 'en' WHEN regexp_matches(url, '^[a-z]+://[^/]*/(de|fr|es)/') THEN 'european' ELSE 'unsegmented' END AS segment FROM pages),
n AS (SELECT segment, count(*) AS pages FROM placed GROUP BY segment),
i AS (SELECT segment, count(*) AS issues FROM found JOIN (SELECT DISTINCT url, segment FROM placed) p ON target_url = p.url GROUP BY segment)
SELECT n.segment, pages, coalesce(issues, 0) AS issues FROM n LEFT JOIN i ON n.segment = i.segment
"""

ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/*.html$\nDisallow: /*?page=\nDisallow: /fr/\nAllow: /fr/\n\nUser-agent: otherbot\nDisallow: /\n"


def robots_access(spark: SparkSession, d: str) -> DataFrame:
    rules = robots.for_agent(robots.rules(spark, ROBOTS), "examplebot")
    return robots.allowed(table(spark, d, "pages").select("page_id", "url"), rules).select("page_id", "allowed")


ROBOTS_ACCESS = f"""
WITH {PARTS}, asked AS (SELECT page_id, path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS p FROM parts)
SELECT page_id, CASE WHEN regexp_matches(p, '^/en/.*\\.html$') THEN TRUE WHEN regexp_matches(p, '^/.*\\?page=') THEN FALSE WHEN p LIKE '/en/%' THEN FALSE ELSE TRUE END AS allowed FROM asked
"""


def page_types(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("url", F.when(F.col("page_id") % 9 == 0, F.array(F.lit("Recipe"))).alias("schema_types"), F.when(F.col("page_id") % 4 == 0, "article").alias("og_type"))
    return scores.page_types(pages)


PAGE_TYPES = """
SELECT url, CASE WHEN page_id % 9 = 0 THEN 'Recipe' WHEN page_id % 4 = 0 THEN 'Article' ELSE 'WebPage' END AS type,
       CASE WHEN page_id % 9 = 0 THEN 'high' WHEN page_id % 4 = 0 THEN 'mid' ELSE 'low' END AS confidence,
       CAST(CASE WHEN page_id % 9 = 0 THEN 5.0 WHEN page_id % 4 = 0 THEN 3.0 ELSE 0.0 END AS DOUBLE) AS score
FROM pages
"""


def boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return html.boilerplate_report(html.parsed_pages(table(spark, d, "pages"), ["boilerplate_hash"]))


def markdown(spark: SparkSession, d: str) -> DataFrame:
    return html.parsed_pages(table(spark, d, "pages"), ["content_strategy", "word_count", "markdown"])


def html_sizes(spark: SparkSession, d: str) -> DataFrame:
    return rollups.size_report(table(spark, d, "pages").select(F.octet_length("html").alias("n")), "n").select("n", *[F.round(c, 4).alias(c) for c in ("median", "p75", "p90", "p95", "iqr")], F.col("most").cast("bigint").alias("most"))


HTML_SIZES = """
SELECT count(*) AS n, round(quantile_cont(strlen(html), 0.5), 4) AS median, round(quantile_cont(strlen(html), 0.75), 4) AS p75, round(quantile_cont(strlen(html), 0.9), 4) AS p90,
       round(quantile_cont(strlen(html), 0.95), 4) AS p95, round(quantile_cont(strlen(html), 0.75) - quantile_cont(strlen(html), 0.25), 4) AS iqr, CAST(max(strlen(html)) AS BIGINT) AS most FROM pages
"""


def redirect_rules(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    to = F.when(F.col("page_id") % 11 != 0, urls.sitemap_key(u))
    return table(spark, d, "pages").select("page_id", *[scores.redirect_rule(u, to, s).alias(s.replace("-", "_")) for s in ("apache-redirect", "apache-rewrite-rule", "nginx")])


REDIRECT_RULES = f"""
WITH {PARTS},
named AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+', '') AS src, CASE WHEN page_id % 11 <> 0 THEN scheme || '://' || host || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS dst FROM parts)
SELECT page_id, CASE WHEN src = '' THEN 'ERROR: Source URL cannot be empty' WHEN dst IS NULL THEN 'ERROR: Target URL is required for this format' ELSE 'Redirect 301 ' || src || ' ' || dst END AS apache_redirect,
  CASE WHEN src = '' THEN 'ERROR: Source URL cannot be empty' WHEN dst IS NULL THEN 'ERROR: Target URL is required for this format' ELSE 'RewriteRule ^' || replace(src, '$', '\\$') || '$ ' || dst || ' [R=301,L]' END AS apache_rewrite_rule,
  CASE WHEN src = '' THEN 'ERROR: Source URL cannot be empty' WHEN dst IS NULL THEN 'ERROR: Target URL is required for this format' ELSE 'rewrite ^' || replace(src, '$', '\\$') || '$ ' || dst || ' permanent;' END AS nginx
FROM named
"""


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", values.fingerprint(F.lit("HTTP_URL"), F.col("url"), F.lit(None)).alias("fingerprint"), values.formula_safe(F.concat(F.lit("="), F.col("page_id").cast("string"))).alias("cell"))


QUERIES = (
    Query("url_identities", url_identities, URL_IDENTITIES),
    Query("url_patterns", url_patterns, URL_PATTERNS),
    Query("url_parameters", parameters, PARAMETERS),
    Query("host_policy", host_policy, HOST_POLICY),
    Query("url_findings", url_findings, URL_FINDINGS),
    Query("page_markup", markup, MARKUP),
    Query("audit_by_check", audit_by_check),
    Query("audit_statuses", audit_statuses),
    Query("audit_score", audit_score),
    Query("task_list", task_list, TASK_LIST),
    Query("compared_audits", compared_audits, COMPARED),
    Query("segment_report", segment_report, SEGMENT_REPORT),
    Query("robots_access", robots_access, ROBOTS_ACCESS),
    Query("page_types", page_types, PAGE_TYPES),
    Query("boilerplate_report", boilerplate),
    Query("page_markdown", markdown),
    Query("html_sizes", html_sizes, HTML_SIZES),
    Query("redirect_rules", redirect_rules, REDIRECT_RULES),
    Query("issue_fingerprints", fingerprints, "SELECT page_id, substr(sha1('HTTP_URL|' || url || '|None'), 1, 12) AS fingerprint, '''=' || CAST(page_id AS VARCHAR) AS cell FROM pages"),
)
