"""Sitemaps: URL sets and indexes in XML, plain lists, both also compressed."""

from __future__ import annotations

import gzip
import io
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes to which a compressed sitemap may unfold.
MOST_BYTES = 64 << 20
ENTRIES = "sitemap string, kind string, loc string, lastmod string, alternates array<struct<lang: string, href: string>>, bytes bigint, error string, truncated boolean"


def parse(raw: bytes, name: str) -> tuple[list[tuple], int, str | None, bool]:
    """(kind, loc, lastmod, alternates) of each entry; bytes; what was wrong; whether it was cut."""
    cut = False
    if raw[:2] == b"\x1f\x8b":
        try:
            raw = gzip.GzipFile(fileobj=io.BytesIO(raw)).read(MOST_BYTES + 1)
        except (OSError, EOFError) as e:
            return [], len(raw), f"not readable: {e}", False
        cut = len(raw) > MOST_BYTES
        raw = raw[:MOST_BYTES]
    size, out = len(raw), []
    if not raw.lstrip()[:1] == b"<":
        return [("url", line.strip(), None, []) for line in raw.decode("utf-8", "replace").lstrip("﻿").splitlines() if line.strip().startswith(("http://", "https://"))], size, None, cut
    plain = lambda tag: tag.rsplit("}", 1)[-1]
    try:
        if b"<!ENTITY" in raw[:65536]:
            return [], size, "entities are not read", cut
        for _, node in ET.iterparse(io.BytesIO(raw), events=("end",)):
            if plain(node.tag) in ("url", "sitemap"):
                own = {plain(c.tag): (c.text or "").strip() for c in node}
                links = [{"lang": c.get("hreflang"), "href": c.get("href")} for c in node if plain(c.tag) == "link" and c.get("hreflang")]
                if own.get("loc"):
                    out.append((plain(node.tag), own["loc"], own.get("lastmod") or None, links))
                node.clear()
    except ET.ParseError as e:
        return out, size, f"not well formed: {e}", cut
    return out, size, None, cut


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """sitemap, kind (url, sitemap, or document for the file itself), loc, lastmod, alternates, bytes, error, truncated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                entries, size, error, cut = parse(bytes(content), name)
                rows = [(name, "document", None, None, [], size, error, cut), *((name, *e, size, None, False) for e in entries)]
                yield pd.DataFrame(rows, columns=["sitemap", "kind", "loc", "lastmod", "alternates", "bytes", "error", "truncated"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ENTRIES)


def frames(entries: DataFrame) -> dict[str, DataFrame]:
    """The frames that audits read."""
    return {
        "sitemap": entries.where("kind = 'url'").select("sitemap", "loc", "lastmod"),
        "sitemap_documents": entries.where("kind = 'document'").select("sitemap", "bytes", "error", "truncated"),
    }


def hreflang(entries: DataFrame) -> DataFrame:
    return entries.where("kind = 'url'").select(F.col("loc").alias("source_url"), F.explode("alternates").alias("a")).select("source_url", F.col("a.href").alias("destination_url"), F.col("a.lang").alias("hreflang"))
