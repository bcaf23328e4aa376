"""Helpers that the corpus operators share: reading tables, shared storage, sizing, stable hashes."""

from __future__ import annotations

import gc
import re
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch that goes to a Python worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only where it is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: By thread: the tables written by each build() that runs, and on the lowest level by whoever keeps an account of them.
_accounts = threading.local()


def open_accounts() -> list[list[str]]:
    if not hasattr(_accounts, "open"):
        _accounts.open = []
    return _accounts.open


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and rereads it: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release_shuffles(spark)
    if open_accounts():
        open_accounts()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that materialize() wrote and nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


def build(spark: SparkSession, tag: str, steps: Callable[[], DataFrame]) -> DataFrame:
    """The table that the steps make, written down; what they wrote on the way is deleted."""
    own: list[str] = []
    open_accounts().append(own)
    try:
        out, path = materialize(steps(), tag)
        own.remove(path)
    finally:
        open_accounts().pop()
        discard(spark, *own)
    if open_accounts():
        open_accounts()[-1].append(path)
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixed(x: np.ndarray) -> np.ndarray:
    """mix64 in place."""
    y = x >> np.uint64(30)
    x ^= y
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(27), out=y)
    x ^= y
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=y)
    x ^= y
    return x


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (multiply and xor-shift), element by element."""
    return mixed(x.astype(np.uint64, copy=True))


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of every run of `width` consecutive 64-bit symbols (order counts)."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += ids[k : k + n]
        mixed(out)
    return out


#: Characters of texts whose words a Python worker holds at once, about.
HELD_CHARS = 1_000_000


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of the texts that have about HELD_CHARS characters."""
    low, chars = 0, 0
    for k, t in enumerate(texts):
        chars += len(t)
        if chars >= HELD_CHARS:
            yield low, k + 1
            low, chars = k + 1, 0
    if low < len(texts):
        yield low, len(texts)


def word_hashes(texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all the texts, one text after the other, and where each text begins, with the end of the last."""
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(texts)), np.uint64, int(starts[-1])), starts


def with_columns_kept(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a missing one becomes null, so that extra or missing columns do no harm.

    Also bounds what a Python worker is given at once, by rows and by bytes, since texts may be long.
    """
    for k, v in BATCHES.items():
        df.sparkSession.conf.set(k, v)
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).alias(n) for n in names])


def stacked(names: list[str], parts: list[tuple]) -> pd.DataFrame:
    """One frame from parts, each a tuple of a column each, of which all but one or more may be scalars."""
    columns: dict[str, list] = {n: [] for n in names}
    for part in parts:
        size = next(len(x) for x in part if isinstance(x, (np.ndarray, list)))
        for n, x in zip(names, part):
            columns[n].append(x if isinstance(x, np.ndarray) else np.fromiter(x if isinstance(x, list) else (x for _ in range(size)), object, size))
    return pd.DataFrame({n: np.concatenate(x) if x else np.empty(0, object) for n, x in columns.items()})


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one, that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a table of ids, 16 bytes each at most, that may be sent to every task.
SENT_ROWS = 500_000


def sized(ids: DataFrame, tag: str) -> DataFrame:
    """A table of ids, written once, to be broadcast in a join if it is known to be small; else it is joined by a shuffle."""
    written, _ = materialize(ids, tag)
    return F.broadcast(written) if written.count() <= SENT_ROWS else written


def ids_as_text(df: DataFrame, name: str = "doc_id") -> tuple[DataFrame, str]:
    """The id as text, since pandas would turn integers among nulls to floats; and its type, to turn it back."""
    kind = dict(df.dtypes)[name]
    return df.withColumn(name, F.col(name).cast("string")), "bigint" if kind == "void" else kind


#: Seconds between collections at least.
COLLECT_EVERY = 3.0
_collected = [0.0]


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that nothing refers to any more, which else waits for the driver's next collection."""
    if time.monotonic() - _collected[0] >= COLLECT_EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()
