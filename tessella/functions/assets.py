"""What the text and headers of scripts and style sheets say about their delivery, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.urls import let

#: Marks of transpiled code, of debugging, of document.write, of source maps, of fonts and of imports.
LEGACY = r"core-js|regeneratorRuntime|_babelPolyfill|@babel/runtime|Object\.assign\s*=\s*function"
DEBUG = r"\bconsole\.(?:log|debug)\s*\(|\bdebugger\b|\balert\s*\("
DOCUMENT_WRITE = r"\bdocument\.write\s*\("
SOURCE_MAP = r"sourceMappingURL=([^\s*]+)"
FONT_FACE = r"(?is)@font-face\s*\{([^}]*)\}"
FONT_DISPLAY = r"(?i)font-display\s*:\s*(swap|fallback|optional)"
IMPORT = r"""(?i)@import\s+(?:url\(\s*)?['"]?([^'"()\s;]+)['"]?\)?"""
MAX_AGE = r"(?i)max-age\s*=\s*(\d+)"
COMPRESSED = ("gzip", "br", "deflate", "zstd")
#: Seconds from which a static file is kept long, imports that are listed, characters shown of a font.
LONG_CACHE, IMPORTS, EXCERPT = 7 * 24 * 3600, 10, 200


def white_share(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(r"(?U)\s")) / F.length(text)).otherwise(0.0)


def looks_minified(text: Column) -> Column:
    """Little white space in long lines; a text under 200 characters is judged by being one line."""

    def judged(t: Column) -> Column:
        lines = F.size(F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"))
        tight = white_share(t) < 0.15
        return F.when(t == "", False).when(F.length(t) < 200, (lines <= 1) & tight).otherwise(tight & (F.length(t) / lines > 200))

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""), judged)


def content_hash(text: Column) -> Column:
    """Of all but white space, so that files that are only wrapped differently are the same."""
    return F.sha2(F.regexp_replace(text, r"(?U)\s+", ""), 256)


def duplicate_libraries(resources: DataFrame) -> DataFrame:
    """resources: url, kind, ok, text; kind, hash, urls (distinct, sorted; the first LISTED) and how many: content that two addresses or more deliver."""
    read = resources.where(F.coalesce("ok", F.lit(False)) & (F.coalesce("text", F.lit("")) != ""))
    each = read.select(F.coalesce("kind", F.lit("")).alias("kind"), content_hash(F.col("text")).alias("hash"), "url").distinct()
    many = each.groupBy("kind", "hash").agg(F.count(F.lit(1)).alias("addresses")).where("addresses > 1")
    return each.join(many, ["kind", "hash"])


def legacy_script(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(LEGACY)


def debug_code(text: Column) -> Column:
    """Marks of debugging, distinct and sorted, of code that is otherwise minified."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({DEBUG})"), F.lit(1))))
    return F.when(looks_minified(text), found).otherwise(F.array().cast("array<string>"))


def document_write(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(DOCUMENT_WRITE)


def source_map(text: Column) -> Column:
    """Where the last comment of its kind says that the source map is; null for none and for one within the file."""

    def last(found: Column) -> Column:
        target = F.when(F.size(found) > 0, F.element_at(found, -1))
        return F.when(~F.lower(target).startswith("data:"), target)

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SOURCE_MAP), F.lit(1)), last)


def fonts_without_display(text: Column) -> Column:
    """The beginnings of @font-face blocks that don't say what is shown meanwhile."""
    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FONT_FACE), F.lit(1))
    return F.transform(F.filter(blocks, lambda b: ~b.rlike(FONT_DISPLAY)), lambda b: F.substring(F.trim(F.regexp_replace(b, r"^\s+|\s+$", "")), 1, EXCERPT))


def css_imports(text: Column) -> Column:
    return F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IMPORT), F.lit(1)), 1, IMPORTS)


def cache_verdict(cache_control: Column) -> Column:
    """(ok, max_age, reason) of a static file's lifetime."""
    value = F.coalesce(cache_control, F.lit(""))
    age = F.regexp_extract(value, MAX_AGE, 1).try_cast("bigint")
    verdict = lambda ok, seconds, reason: F.struct(F.lit(ok).alias("ok"), seconds.cast("bigint").alias("max_age"), F.lit(reason).cast("string").alias("reason"))
    return (
        F.when(F.lower(value).rlike("no-store|no-cache"), verdict(False, F.lit(0), "no-store/no-cache on a static asset"))
        .when(age.isNull(), verdict(False, F.lit(None), "no Cache-Control max-age"))
        .when(F.lower(value).contains("immutable") | (age >= LONG_CACHE), verdict(True, age, None))
        .otherwise(verdict(False, age, "max-age is short for a static asset"))
    )


def compressed(content_encoding: Column) -> Column:
    """Whether a response came compressed, by any of the encodings it names."""
    named = F.transform(F.split(F.lower(F.coalesce(content_encoding, F.lit(""))), ","), F.trim)
    return F.arrays_overlap(named, F.array(*map(F.lit, COMPRESSED)))


def render_blocking(tag: Column, attributes: Column) -> Column:
    """Whether a script or a style sheet link in the head holds up the first paint; attributes: a map with lower-case names."""
    own = lambda name: F.lower(F.trim(F.coalesce(attributes[name], F.lit(""))))
    script = ~F.map_contains_key(attributes, "async") & ~F.map_contains_key(attributes, "defer") & own("type").isin("", "text/javascript", "application/javascript") & (own("src") != "")
    sheet = F.array_contains(F.split(own("rel"), r"\s+"), "stylesheet") & own("media").isin("", "all", "screen") & (own("href") != "")
    return F.when(tag == "script", script).when(tag == "link", sheet).otherwise(False)
