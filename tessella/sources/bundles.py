"""Bundles of tables from other crawlers: a manifest says which column is which field, and what was not exported.

Rows are kept, whatever their cells; what a cell should be and isn't is counted and marked, not dropped.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import urls, values
from tessella.operators.joins import duplicate_rows
from tessella.operators.rollups import field_coverage

#: Datasets, their fields and types.
DATASETS: dict[str, dict[str, str]] = {
    "pages": {"url": "url", "status_code": "integer", "content_type": "string", "title": "string", "canonical_url": "url", "indexability": "string"},
    "links": {"source_url": "url", "destination_url": "url", "anchor": "string", "rel": "string", "position": "string", "status_code": "integer"},
    "statuses": {"url": "url", "status_code": "integer", "status_text": "string"},
    "redirects": {"source_url": "url", "destination_url": "url", "status_code": "integer", "hop": "integer"},
}
IDENTITY = {"pages": ["url"], "links": ["source_url", "destination_url"], "statuses": ["url"], "redirects": ["source_url", "destination_url"]}


@dataclass
class Bundle:
    """tables: typed rows with `errors` (fields whose cell isn't of its type); coverage; duplicates; reasons of absent datasets."""

    tables: dict[str, DataFrame]
    coverage: dict[str, DataFrame]
    duplicates: dict[str, DataFrame]
    absent: dict[str, str]


def typed(cell: Column, kind: str) -> Column:
    s = values.text(cell)
    return values.integer(cell) if kind == "integer" else urls.sitemap_key(s) if kind == "url" else s


def read_bundle(spark: SparkSession, manifest_path: str) -> Bundle:
    manifest = json.loads(spark.read.text(manifest_path, wholetext=True).first()[0])
    folder = manifest_path.rsplit("/", 1)[0]
    out = Bundle({}, {}, {}, {})
    for name, about in manifest["datasets"].items():
        if name not in DATASETS:
            raise ValueError(f"unknown dataset {name}")
        if not about.get("file"):
            out.absent[name] = about.get("reason") or "not exported"
            continue
        raw = spark.read.options(header=True, multiLine=True, escape='"').csv(f"{folder}/{about['file']}")
        headers = about.get("columns") or about.get("fields") or {}
        at = {f: headers.get(f, f) for f in DATASETS[name]}
        if unknown := [h for f, h in at.items() if f in headers and h not in raw.columns]:
            raise ValueError(f"{name} has no column {', '.join(unknown)}")
        cells = {f: (F.col(f"`{h}`") if h in raw.columns else F.lit(None).cast("string")) for f, h in at.items()}
        wrong = F.array_compact(F.array(*[F.when(values.text(c).isNotNull() & typed(c, DATASETS[name][f]).isNull(), F.lit(f)) for f, c in cells.items()]))
        table = raw.select(*[typed(c, DATASETS[name][f]).alias(f) for f, c in cells.items()], wrong.alias("errors"))
        out.tables[name] = table
        judged = raw.select(*[values.text(c).alias(f) for f, c in cells.items()])
        out.coverage[name] = field_coverage(judged, {f: typed(F.col(f), DATASETS[name][f]).isNotNull() for f in cells}).withColumn("state", F.when(F.col("field").isin([f for f, h in at.items() if h not in raw.columns] or [""]), "not_exported").otherwise(F.col("state")))
        out.duplicates[name] = duplicate_rows(table, IDENTITY[name])
    return out
