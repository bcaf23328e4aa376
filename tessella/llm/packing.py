"""Packing of tokenized documents into sequences of fixed length, by a grouping genetic algorithm.

A document longer than a sequence is cut into whole sequences with a shorter first piece.  Whole pieces
are sequences already.  The others are dealt by hash into demes of bounded size, each evolved on several
islands: crossover injects well-filled bins of one parent into the other, takes out the bins that hold the
same documents again, and puts the displaced ones back by best fit.  After the first epoch the elite of
each island moves to the next one, which evolves it together with its own.  Documents in bins that stay
poorly filled then meet in fewer demes, until those are few or no longer shrink.

Null text counts as empty and takes one token, the separator.  Repeated rows are packed as often as they
occur; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import discard, ids_as_text, materialize, read_table, with_columns_kept
from tessella.llm.token_counts import encoding, token_ids

#: Token after each document.
SEPARATOR = 0
#: Pieces that one deme holds about, so that a task's memory is bounded at any input size.
DEME = 12_000
ISLANDS = 2
POPULATION = 4
GENERATIONS = 6
#: A bin with less free space, as a share of the sequence, is settled; the others' documents are packed again.
SETTLED = 0.002
MAX_LEVELS = 4


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized_pieces(docs: DataFrame, capacity: int, tokenizer: str | None = None) -> DataFrame:
    """pid (any unique number), doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        pid = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = token_ids(enc, text) if isinstance(text, str) and text else []
                raw = np.asarray([*ids, SEPARATOR], "<u4")
                for k, (start, length) in enumerate(cut_points(len(raw), capacity)):
                    rows.append((pid, doc_id, k, start, length, zlib.crc32(raw[start : start + length].tobytes())))
                    pid += 1
            yield pd.DataFrame(rows, columns=["pid", "doc_id", "piece", "start", "length", "ids_crc32"])

    kept, kind = ids_as_text(with_columns_kept(docs, "doc_id", "text"))
    return kept.mapInPandas(run, "pid long, doc_id string, piece int, start long, length long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast(kind))


class Deme:
    """The pieces of one deme and the moves on packings of them; a packing is an array: piece -> bin."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int) -> None:
        self.lengths, self.capacity, self.random = lengths, capacity, random.Random(seed)
        self.bound = max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))

    def insert(self, bins: np.ndarray, free: list[int], items: np.ndarray) -> np.ndarray:
        """Best fit: each item to the fullest bin that still takes it, or a new one. free is changed."""
        by_free: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for b, f in enumerate(free):
            if f:
                by_free[f].append(b)
                mask |= 1 << f
        lengths = self.lengths
        for i in items.tolist():
            size = int(lengths[i])
            rest = mask >> size
            if rest:
                f = size + (rest & -rest).bit_length() - 1
                b = by_free[f].pop()
                if not by_free[f]:
                    mask ^= 1 << f
            else:
                f, b = self.capacity, len(free)
                free.append(f)
            bins[i], free[b] = b, f - size
            if f > size:
                by_free[f - size].append(b)
                mask |= 1 << (f - size)
        return bins

    def descending(self, items: np.ndarray, jitter: float = 0.0) -> np.ndarray:
        size = self.lengths[items].astype(float)
        if jitter:
            size *= 1 + jitter * np.random.default_rng(self.random.getrandbits(32)).random(len(items))
        return items[np.argsort(-size, kind="stable")]

    def fresh(self, jitter: float = 0.0) -> np.ndarray:
        return self.insert(np.full(len(self.lengths), -1, np.int64), [], self.descending(np.arange(len(self.lengths)), jitter))

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, weights=self.lengths).astype(np.int64)

    def fitness(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins first; among equals the more unevenly filled, which leaves more room in one place."""
        fill = self.fills(bins) / self.capacity
        return len(fill), -float((fill * fill).sum())

    def repacked(self, bins: np.ndarray, displaced: np.ndarray) -> np.ndarray:
        """The packing with the displaced items put back by best fit; bins are numbered anew."""
        stay = np.setdiff1d(np.arange(len(bins)), displaced, assume_unique=True)
        out = np.full(len(bins), -1, np.int64)
        if len(stay):
            _, out[stay] = np.unique(bins[stay], return_inverse=True)
            free = (self.capacity - np.bincount(out[stay], weights=self.lengths[stay])).astype(np.int64).tolist()
        else:
            free = []
        return self.insert(out, free, self.descending(displaced))

    def crossed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fill = self.fills(b)
        good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
        chosen = np.asarray([g for g in good.tolist() if self.random.random() < 0.5], np.int64)
        injected = np.isin(b, chosen)
        hit = np.isin(a, np.unique(a[injected]))
        out = a.copy()
        out[injected] = b[injected] + (int(a.max()) + 1)
        return self.repacked(out, np.flatnonzero(hit & ~injected))

    def mutated(self, bins: np.ndarray) -> np.ndarray:
        """The emptiest bins and some others are dissolved."""
        fill = self.fills(bins)
        worst = np.argsort(fill, kind="stable")[: max(2, len(fill) // 50)]
        others = np.asarray([self.random.randrange(len(fill)) for _ in range(max(2, len(fill) // 20))])
        return self.repacked(bins, np.flatnonzero(np.isin(bins, np.concatenate([worst, others]))))

    def evolved(self, given: list[np.ndarray], generations: int) -> np.ndarray:
        people = [*given, *(self.fresh(0.0 if k == 0 else 0.15 * k) for k in range(max(0, POPULATION - len(given))))]
        people.sort(key=self.fitness)
        for _ in range(generations):
            if self.fitness(people[0])[0] <= self.bound:
                break
            a, b = self.random.sample(people, 2) if len(people) > 1 else (people[0], people[0])
            children = [self.crossed(people[0], b), self.crossed(b, people[0]), self.mutated(people[0]), self.mutated(a)]
            people = sorted([*people, *children], key=self.fitness)[:POPULATION]
        return people[0]


def evolve_islands(items: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """items: deme, island, origin, pid, length, bin (null before the first epoch); the elite of each island."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = rows[rows["origin"] == rows["origin"].min()].sort_values("pid")
        deme = Deme(first["length"].to_numpy(np.int64), capacity, (int(key[0]) * 1_000_003 + int(key[1])) * 31 + epoch)
        given = [] if epoch == 0 else [own.sort_values("pid")["bin"].to_numpy(np.int64) for _, own in rows.groupby("origin")]
        best = deme.evolved(given, GENERATIONS)
        return pd.DataFrame({"deme": key[0], "island": key[1], "pid": first["pid"].to_numpy(), "length": first["length"].to_numpy(), "bin": best, "bins": int(best.max()) + 1})

    return items.groupBy("deme", "island").applyInPandas(run, "deme long, island int, pid long, length long, bin long, bins long")


def evolve(pieces: DataFrame, capacity: int, demes: int) -> DataFrame:
    """deme, pid, length, bin of the best island of each deme, after two epochs with migration between them."""
    dealt = pieces.select(F.pmod(F.xxhash64("pid"), F.lit(demes)).alias("deme"), "pid", "length")
    islands = F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)]))
    start = dealt.select("*", islands.alias("island"), F.lit(0).alias("origin"), F.lit(None).cast("long").alias("bin"))
    elite = evolve_islands(start, capacity, 0)
    moved = elite.select("deme", F.explode(F.array("island", ((F.col("island") + 1) % ISLANDS).cast("int"))).alias("island"), F.col("island").alias("origin"), "pid", "length", "bin")
    last, path = materialize(evolve_islands(moved, capacity, 1), "packing-islands")
    best = last.groupBy("deme").agg(F.min(F.struct("bins", "island")).alias("best")).select(F.col("deme").alias("of"), F.col("best.island").alias("winner"))
    return last.join(best, (last.deme == best.of) & (last.island == best.winner)).select("deme", "pid", "length", "bin"), path


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document once."""
    spark = docs.sparkSession
    pieces, _ = materialize(tokenized_pieces(docs, capacity, tokenizer), "packing-pieces")
    settled = [pieces.where(F.col("length") == capacity).select("pid", (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = pieces.where(F.col("length") < capacity).select("pid", "length")
    n, used = rest.count(), []
    for level in range(MAX_LEVELS):
        if not n:
            break
        demes = max(1, -(-n // DEME))
        packed, path = evolve(rest, capacity, demes)
        sums = packed.groupBy("deme", "bin").agg(F.sum("length").alias("fill"), F.sort_array(F.collect_list(F.struct("pid", "length"))).alias("own"))
        open_bin = F.col("fill") < int(capacity * (1 - SETTLED))
        final = sums if demes == 1 or level == MAX_LEVELS - 1 else sums.where(~open_bin)
        placed = final.select(
            (F.lit(level << 56) + F.col("deme") * (1 << 28) + F.col("bin")).alias("sequence_id"),
            F.posexplode("own").alias("at", "one"),
            "own",
        ).select(
            "one.pid",
            "sequence_id",
            F.expr("aggregate(slice(own, 1, at), 0L, (x, y) -> x + y.length)").alias("offset"),
        )
        placed, placed_path = materialize(placed, "packing-placed")
        settled.append(placed)
        if final is sums:
            discard(spark, path, *used)
            break
        left, left_path = materialize(sums.where(open_bin).select(F.explode("own").alias("one")).select("one.pid", "one.length"), "packing-left")
        discard(spark, path, *used)
        used = [left_path]
        rest, n, before = left, left.count(), n
        if n > 0.8 * before and level < MAX_LEVELS - 2:  # they don't fit each other; one more level settles them
            demes_left = max(1, -(-n // DEME))
            packed, path = evolve(rest, capacity, demes_left)
            sums = packed.groupBy("deme", "bin").agg(F.sort_array(F.collect_list(F.struct("pid", "length"))).alias("own"))
            placed, _ = materialize(
                sums.select((F.lit((level + 1) << 56) + F.col("deme") * (1 << 28) + F.col("bin")).alias("sequence_id"), F.posexplode("own").alias("at", "one"), "own").select("one.pid", "sequence_id", F.expr("aggregate(slice(own, 1, at), 0L, (x, y) -> x + y.length)").alias("offset")),
                "packing-placed",
            )
            settled.append(placed)
            discard(spark, path, *used)
            break
    where = settled[0]
    for more in settled[1:]:
        where = where.unionByName(more)
    return pieces.join(where, "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
