"""The incremental path: logs and events as streams, with watermarks, and state that is let go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.sources import logs


def log_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of log files as they appear, read as the batch reader does."""
    return logs.parsed(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder))


def daily_hits(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """family, day, hits: tumbling days; what is later than the watermark is dropped."""
    return logs.with_bots(rows).withWatermark("time", late).groupBy("family", F.window("time", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("hits")).select("family", F.to_date("w.start").alias("day"), "hits")


def windowed(events: DataFrame, time: str, keys: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by keys and tumbling, or with `slide` sliding, windows."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, time: str, key: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def breaker(events: DataFrame, limit: int, forget: int | None = None) -> DataFrame:
    """host, streak, open: fetches (host, seq, status) stream; a run of refusals, server errors and silences opens the breaker of a host.

    forget: milliseconds after which a silent host's streak is dropped, for streams that go on; a stream that ends when it
    has read what is there would wait for timeouts for ever, and has none."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq")
        for status in rows["status"]:
            bad = pd.isna(status) or status == 429 or status >= 500
            streak = streak + 1 if bad else 0
        state.update((streak,))
        if forget:
            state.setTimeoutDuration(forget)
        yield pd.DataFrame({"host": [key[0]], "streak": [streak], "open": [streak >= limit]})

    return events.groupBy("host").applyInPandasWithState(run, "host string, streak int, open boolean", "streak int", "update", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def capped_sink(events: DataFrame, path: str, checkpoint: str, cap: int) -> StreamingQuery:
    """Writes events up to `cap` in all, in order of sequence within a batch, and after each batch how many were kept and dropped."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = _written(spark, path)
        total = batch.count()
        room = max(0, cap - done)
        kept = min(total, room)
        if kept:
            batch.orderBy("sequence").limit(kept).write.mode("append").parquet(f"{path}/events")
        spark.createDataFrame([(number, kept, total - kept)], "batch bigint, captured bigint, dropped bigint").write.mode("append").parquet(f"{path}/coverage")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/coverage")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return 0
    return spark.read.parquet(f"{path}/coverage").agg(F.coalesce(F.sum("captured"), F.lit(0))).first()[0]


def all_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now and stops; a later call goes on from its checkpoint."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start().awaitTermination()
