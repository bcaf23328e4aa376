"""Table exports: found by name, read with whatever encoding they have, projected on canonical fields.

Everything is read as text; a field that no column carries is null and remembered as absent, which is not the
same as blank.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import values
from tessella.schemas import DECIMALS, HREFLANG_HEADERS, INTEGERS, LINK_HEADERS, PAGE_HEADERS, page_type

#: Marks at a file's beginning and the encodings they stand for.
MARKS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))
#: Words that an export's file name has and hasn't, by logical name.
EXPORTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "internal_all": (("internal", "all"), ()),
    "inlinks_4xx": (("client_error", "inlinks"), ()),
    "inlinks_5xx": (("server_error", "inlinks"), ()),
    "inlinks_3xx": (("redirection", "inlinks"), ()),
    "all_inlinks": (("all_inlinks",), ()),
    "hreflang": (("all_hreflang",), ()),
    "hreflang_errors": (("hreflang",), ("all_hreflang", "inlinks")),
    "titles_multiple": (("page_titles", "multiple"), ()),
    "images_missing_alt": (("images", "missing_alt_text"), ("inlinks",)),
    "images_over_kb": (("images", "over"), ("inlinks", "alt_text")),
    "images_missing_size": (("images", "missing_size"), ("inlinks",)),
    "security_mixed": (("security", "mixed_content"), ()),
    "security_hsts": (("security", "hsts"), ()),
    "structured_data_missing": (("structured_data", "missing"), ()),
    "sitemap_urls": (("sitemaps", "urls_in_sitemap"), ()),
    "sitemap_non_200": (("sitemaps", "non_200"), ()),
    "sitemap_redirects": (("sitemaps", "redirect"), ()),
    "sitemap_non_indexable": (("sitemaps", "non_indexable"), ()),
    "redirect_chains": (("redirect_chains",), ()),
}
REQUIRED = ("internal_all",)


@dataclass
class Export:
    """rows: the canonical fields; present: those that the export carries; encoding: as read."""

    rows: DataFrame
    present: frozenset[str]
    encoding: str


def encoding_of(spark: SparkSession, path: str) -> str:
    """By the mark at its beginning; without one UTF-8 if that reads it, else windows-1251."""
    head = spark.read.format("binaryFile").load(path).select(F.expr("substring(content, 1, 65536)").alias("head")).first()
    raw = bytes(head[0]) if head else b""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return name
    try:
        raw[: len(raw) - 4].decode() if len(raw) == 65536 else raw.decode()
        return "UTF-8"
    except UnicodeDecodeError as e:
        return "UTF-8" if len(raw) == 65536 and e.start >= len(raw) - 8 else "windows-1251"


def read_table(spark: SparkSession, path: str, encoding: str | None = None) -> tuple[DataFrame, str]:
    code = encoding or encoding_of(spark, path)
    name = "UTF-16" if code.startswith("UTF-16") else code
    df = spark.read.options(header=True, multiLine=True, escape='"', encoding=name).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]), code


def matching(names: Iterable[str], logical: str) -> str | None:
    """The one file that the logical name means; several are an error."""
    having, lacking = EXPORTS[logical]
    found = [n for n in names if all(w in n.lower().replace(" ", "_") for w in having) and not any(w in n.lower().replace(" ", "_") for w in lacking)]
    if logical in ("inlinks_4xx", "inlinks_5xx", "inlinks_3xx"):
        found = [n for n in found if "inlinks" in n.lower()]
    if len(found) > 1:
        raise ValueError(f"{logical} may be any of {', '.join(sorted(found))}")
    return found[0] if found else None


def resolved(columns: Iterable[str], headers: dict[str, tuple[str, ...]]) -> dict[str, str | None]:
    """The column of each field: the first of its headers that is there, whatever its case."""
    have = {c.lower(): c for c in columns}
    return {f: next((have[h.lower()] for h in names if h.lower() in have), None) for f, names in headers.items()}


def projected(df: DataFrame, headers: dict[str, tuple[str, ...]], encoding: str = "") -> Export:
    """Only the canonical fields, typed."""
    at = resolved(df.columns, headers)

    def cell(f: str) -> object:
        if at[f] is None:
            return F.lit(None).cast(page_type(f) if headers is PAGE_HEADERS else T.StringType()).alias(f)
        raw = F.col(f"`{at[f]}`")
        kind = page_type(f) if headers is PAGE_HEADERS else T.LongType() if f in INTEGERS else T.StringType()
        if isinstance(kind, (T.ArrayType, T.StructType)):
            return F.from_json(raw, kind).alias(f)
        return (values.integer(raw) if isinstance(kind, T.LongType) else values.real(raw) if f in DECIMALS else values.text(raw)).alias(f)

    return Export(df.select(*[cell(f) for f in headers]), frozenset(f for f, c in at.items() if c is not None), encoding)


def read_pages(spark: SparkSession, path: str) -> Export:
    out = projected(*_two(read_table(spark, path), PAGE_HEADERS))
    return Export(out.rows.withColumn("ordinal", F.monotonically_increasing_id()), out.present, out.encoding)


def read_links(spark: SparkSession, path: str) -> Export:
    return projected(*_two(read_table(spark, path), LINK_HEADERS))


def read_hreflang(spark: SparkSession, path: str) -> Export:
    return projected(*_two(read_table(spark, path), HREFLANG_HEADERS))


def _two(read: tuple[DataFrame, str], headers: dict[str, tuple[str, ...]]) -> tuple[DataFrame, dict[str, tuple[str, ...]], str]:
    return read[0], headers, read[1]


def load_exports(spark: SparkSession, folder: str) -> tuple[dict[str, Export], list[str]]:
    """All exports of a folder by logical name, and those that aren't there; required ones must be."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = [s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    names = [f for f in files if f.lower().endswith(".csv")]
    out, absent = {}, []
    for logical in EXPORTS:
        name = matching(names, logical)
        if name is None:
            absent.append(logical)
            continue
        path = f"{folder}/{name}"
        out[logical] = read_pages(spark, path) if logical == "internal_all" else read_hreflang(spark, path) if logical == "hreflang" else read_links(spark, path) if "inlinks" in logical else projected(*_two(read_table(spark, path), {"url": ("Address", "URL")}))
    if lost := [r for r in REQUIRED if r in absent]:
        raise FileNotFoundError(f"no export for {', '.join(lost)} in {folder}")
    return out, absent


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Every URL in every line or cell of a text file, as often as it occurs."""
    return spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"(https?://[^\s\"'<>,;]+)"), F.lit(1))).alias("url"))


#: Links, as a crawl writes them, from the rows of an export.
def links_of(export: DataFrame) -> DataFrame:
    return export.where("destination_url is not null").select(
        F.col("source_url").alias("source"),
        F.col("destination_url").alias("destination"),
        "anchor",
        (~values.truth(F.col("follow"))).alias("nofollow"),
        F.lower("link_position").alias("position"),
        F.filter(F.split(F.coalesce("rel", F.lit("")), r"\s+"), lambda r: r != "").alias("rel"),
        "target",
        F.col("destination_url").alias("raw_href"),
        F.monotonically_increasing_id().alias("seq"),
    )
