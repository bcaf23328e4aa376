"""Exact n-gram Jaccard join, in tiles by size with hashed bitmap signatures.

A document is the set of its distinct n-word shingles.  Documents with equal sets are one class from the start.
Sizes fall into bands so that a link never spans more than two neighbouring ones, and a link between sets of a
band has at most so many shingles that only one side has.  With one part more than that, dealt by hash, the two
sets agree in one part entirely.  Classes of a tile, which is a band together with a part's content, are therefore
all that can link, and sharing a frequent passage is not enough to be in one.

Empty parts would make tiles of everything that has one by chance.  So some more parts are dealt than are needed, as
many as are likely to be empty; only a set with so many empty parts that a link of it might agree in nothing else
is in the tiles of its empty parts, too.

A pair within a tile is first bounded by size, then by bitmaps as wide as the sets are large: bits that only
one of the two has stand for at least as many shingles that the other lacks.  Only pairs within both bounds
meet as sorted arrays.

Pairs are not listed group by group.  In each round a tile compares its classes with one pivot, linked
classes grow into components, and tiles that lie within one component are done: a group of thousands of
near copies takes about as many comparisons as it has members.  What the rounds leave, classes of different
components in one tile, is compared completely, so that no link between components is lost.

Texts are lower-cased (A-Z) and split at ASCII white space.  A text of fewer words than n is one shingle;
one without words, or null, has none and links with nothing.  Repeated rows are of one class.  Null doc_ids
are members like others, but give no component_id unless a class has no other; then it is null.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import build, discard, ids_as_text, materialize, mix64, read_table, window_hashes, with_columns_kept, word_hashes
from tessella.operators.components import connected_components

#: Bits of a bitmap at least and at most; in between the next power of two above four times the size.
LEAST_BITS, MOST_BITS = 64, 1 << 18
#: Classes of a tile, or of one of its blocks, that are compared with each other in one group, about.
TILE = 256
#: Parts of the keys that are counted one after the other, so that a part only of their shuffle is on disk.
TURNS = 3
ROUNDS = 2
#: From so many parts on, some more are dealt than a link can differ in.
LEAST_PARTS = 8
#: Pairs whose ids are sent to all tasks to pick texts and arrays, 16 bytes each; more are joined by a shuffle.
SENT_IDS = 500_000

class Bands:
    """Bands of sizes: whatever may link to a set of one band lies in it, in the next, or in the one before."""

    def __init__(self, percent: int) -> None:
        self.percent, self.edges = percent, [1]
        self.dealt: dict[int, int] = {}

    def of(self, n: int) -> int:
        e = self.edges
        while e[-1] <= n:
            e.append(max(e[-1] + 1, (e[-1] - 1) * 100 // self.percent + 1))
        return bisect.bisect_right(e, n) - 1

    def top(self, band: int) -> int:
        """The largest size of a band."""
        while len(self.edges) < band + 2:
            self.of(self.edges[-1])
        return self.edges[band + 1] - 1

    def apart(self, a: int, b: int) -> int:
        """Shingles that sets of these sizes that link can have on one side only."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def parts(self, band: int) -> int:
        """Parts for a band's tiles: one more than a link can differ in, and some more for parts that are empty by chance."""
        if (found := self.dealt.get(band)) is None:
            most = self.top(band)
            found = self.apart(most, 100 * most // self.percent) + 1
            if found >= LEAST_PARTS:
                empty = found * math.exp(-most / found)
                found += math.ceil(empty + 2 * math.sqrt(empty))
            self.dealt[band] = found
        return found

    def empties(self, n: int, band: int) -> int:
        """The empty parts that a set of size n must have in a band's tiles for a link of it to agree in nothing but empty parts."""
        other = 100 * n // self.percent if band == self.of(n) else self.top(band)
        return self.parts(band) - self.apart(n, other)


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, n: int) -> None:
        self.n = n

    def all(self, texts: list[str | None]) -> list[np.ndarray]:
        hashes, starts = word_hashes([t.encode("utf-8", "surrogatepass").lower().split() if isinstance(t, str) else [] for t in texts])
        runs, out = window_hashes(hashes, self.n), []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a < self.n:
                out.append(window_hashes(hashes[a:b], b - a) ^ np.uint64(b - a) if b > a else np.empty(0, np.uint64))
            else:
                own = np.sort(runs[a : b - self.n + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        return self.all([text])[0]


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set."""
    k = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (k & (1 << 64) - 1) - (1 << 63), (k >> 64) - (1 << 63)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(shingles) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(mix64(shingles) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def tile_keys(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """A key for each part of the set, for the tiles of its own band and, as the larger side, of the one before."""
    own = bands.of(len(shingles))
    mixed_ = mix64(shingles ^ np.uint64(0x5851F42D4C957F2D))
    out = []
    for band in sorted({own, max(own - 1, 0)}):
        parts = bands.parts(band)
        at = (shingles % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, at, mixed_)
        filled = np.flatnonzero(np.bincount(at, minlength=parts))
        out.append(mix64(sums[filled] + mix64(filled.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band))))
        if parts - len(filled) >= bands.empties(len(shingles), band):
            empty = np.setdiff1d(np.arange(parts), filled)
            out.append(mix64(mix64(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band))))
    return np.concatenate(out).view(np.int64)


def shingled(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """docs: doc_id, text, th (hash of the text).  A row for each document: uid, doc_id, th, n, k1, k2 (hash of the set),
    keys (of its tiles), bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, bands = Shingler(n), Bands(percent)
        own_uid = TaskContext.get().partitionId() << 36
        nothing = np.empty(0, np.int64)
        for batch in batches:
            rows = []
            for doc_id, th, own in zip(batch["doc_id"], batch["th"], shingle.all(batch["text"].tolist())):
                rows.append((own_uid, doc_id, int(th), len(own), *set_hash(own), *((tile_keys(own, bands), bitmap(own)) if len(own) else (nothing, nothing))))
                own_uid += 1
            yield pd.DataFrame(rows, columns=["uid", "doc_id", "th", "n", "k1", "k2", "keys", "bits"])

    rows, kind = ids_as_text(docs)
    return rows.mapInPandas(run, "uid long, doc_id string, th long, n long, k1 long, k2 long, keys array<long>, bits array<long>").withColumn("doc_id", F.col("doc_id").cast(kind))


def arrays_of(docs: DataFrame, n: int) -> DataFrame:
    """k1, k2, shingles (sorted, 8 bytes each)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for batch in batches:
            own = shingle.all(batch["text"].tolist())
            yield pd.DataFrame([(*set_hash(x), x.tobytes()) for x in own], columns=["k1", "k2", "shingles"])

    return docs.select("text").mapInPandas(run, "k1 long, k2 long, shingles binary")


def alike_in_size(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def folded(bits: str, other: str) -> Column:
    """The bitmap at the width of the narrower of the two; sizes of a pair differ by less than a factor of two."""
    n = F.size(bits)
    half = (n / 2).cast("int")
    return F.when(n <= F.size(other), F.col(bits)).otherwise(F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda a, b: a.bitwiseOR(b)))


def within_bound(percent: int, a: str = "x", b: str = "y") -> Column:
    """Whether the bits that only one side has leave enough shingles in common."""
    mine, theirs = folded(f"{a}.bits", f"{b}.bits"), folded(f"{b}.bits", f"{a}.bits")
    only = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)
    most = F.least(F.col(f"{a}.n") - only(mine, theirs), F.col(f"{b}.n") - only(theirs, mine))
    return 100 * most >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n") - most)


class Join:
    """The state of one join: classes, their arrays, links found so far."""

    def __init__(self, docs: DataFrame, n: int, percent: int) -> None:
        self.percent, self.spark = percent, docs.sparkSession
        self.n, self.docs = n, with_columns_kept(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("th"))
        sets, path = materialize(shingled(self.docs, n, percent), "join-sets")
        self.members, _ = materialize(sets.select("doc_id", "n", "k1", "k2", "uid", "th"), "join-members")
        self.classes, _ = materialize(self.members.where("n > 0").groupBy("k1", "k2").agg(F.min("uid").alias("cid"), F.min("doc_id").alias("low"), F.first("n").alias("n"), F.min("th").alias("th")), "join-classes")
        chosen = self.classes.select("cid")
        self.signatures = sets.select(F.col("uid").alias("cid"), "n", "bits", "keys")
        if chosen.count() <= SENT_IDS:
            self.signatures = self.signatures.join(F.broadcast(chosen), "cid", "left_semi")
        else:  # too many to send: they are joined once
            self.signatures, _ = materialize(self.signatures.join(chosen, "cid", "left_semi"), "join-signatures")
            discard(self.spark, path)
        self.links: DataFrame | None = None

    def tiles(self) -> tuple[DataFrame, DataFrame]:
        """a, b: the two classes of tiles of two; and key, cid, n: the classes of the tiles of more."""
        rows = self.signatures.select("cid", "n", F.explode("keys").alias("key"))
        counted = None
        for turn in range(TURNS):
            some = rows.where(F.pmod("key", F.lit(TURNS)) == turn).groupBy("key").agg(F.min("cid").alias("a"), F.max("cid").alias("b"), F.count(F.lit(1)).alias("size")).where("a <> b")
            some, _ = materialize(some, "join-counted")
            counted = some if counted is None else counted.unionByName(some)
        large = counted.where("size > 2").select("key")
        sent = F.broadcast if large.count() <= SENT_IDS else (lambda df: df)
        more, _ = materialize(rows.join(sent(large), "key", "left_semi").select("key", "cid", "n"), "join-tiles")
        return counted.where("size = 2").select("a", "b"), more

    def several(self, tiles: DataFrame) -> DataFrame:
        """Only the tiles with classes of several components."""
        mixed = tiles.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("key")
        return tiles.join(mixed, "key", "left_semi")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """a, b of those pairs whose sets are similar enough, by merging their sorted arrays.

        The arrays are made anew from the texts of the classes that are wanted, so that they needn't be kept for all.
        """
        pairs, pairs_path = materialize(pairs, "join-pairs")
        n = pairs.count()
        if not n:
            return pairs
        sent = F.broadcast if n <= SENT_IDS else (lambda df: df)
        ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        wanted, wanted_path = materialize(ids.join(self.classes, "cid").select("cid", "k1", "k2", "th"), "join-wanted")
        texts = self.docs.join(sent(wanted.select("th").distinct()), "th", "left_semi")
        arrays = arrays_of(texts, self.n).join(sent(wanted.select("k1", "k2", "cid")), ["k1", "k2"]).select("cid", "shingles").dropDuplicates(["cid"])
        arrays, arrays_path = materialize(arrays, "join-arrays")
        percent = self.percent

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ok = []
                for x, y in zip(batch["x"], batch["y"]):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.loc[ok, ["a", "b"]]

        # Members' arrays move once, to their pivot's.
        moved = arrays.join(sent(pairs), arrays.cid == F.col("b")).select("a", "b", F.col("shingles").alias("y"))
        pivots = arrays.join(sent(pairs.select("a").distinct()), arrays.cid == F.col("a"), "left_semi").select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
        links, _ = materialize(moved.join(pivots, "a").select("a", "b", "x", "y").mapInPandas(run, "a long, b long"), "join-links")
        discard(self.spark, pairs_path, arrays_path, wanted_path)
        return links

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """The distinct pairs that sizes and bitmaps leave."""
        x = self.signatures.select(F.col("cid").alias("a"), F.struct("n", "bits").alias("x"))
        y = self.signatures.select(F.col("cid").alias("b"), F.struct("n", "bits").alias("y"))
        return pairs.distinct().join(x, "a").join(y, "b").where(alike_in_size(F.col("x.n"), F.col("y.n"), self.percent)).where(within_bound(self.percent)).select("a", "b")

    def grown(self, tiles: DataFrame, links: DataFrame) -> DataFrame:
        """The tiles with components that the links have joined."""
        if links.isEmpty():
            return tiles
        self.links = links if self.links is None else self.links.unionByName(links)
        comp = connected_components(self.links, cut=lambda df: materialize(df, "join-stars")[0]).select(F.col("node").alias("cid"), F.col("component").alias("new"))
        return tiles.drop("comp").join(comp, "cid", "left").select("key", "cid", "n", F.coalesce("new", "cid").alias("comp"))

    def link(self) -> None:
        twos, tiles = self.tiles()
        tiles = tiles.withColumn("comp", F.col("cid"))
        for turn in range(ROUNDS):
            if turn:
                tiles, _ = materialize(self.several(tiles), "join-open")
                if tiles.isEmpty():
                    return
            # The least class first, so that copies meet the same one in most of their tiles; then others.
            order = F.col("cid") if turn == 0 else F.xxhash64("comp", F.lit(turn))
            pivot = tiles.groupBy("key").agg(F.min(F.struct(order.alias("order"), "cid", "comp")).alias("p"))
            pairs = tiles.join(pivot, "key").where(F.col("comp") != F.col("p.comp")).select(F.least("cid", "p.cid").alias("a"), F.greatest("cid", "p.cid").alias("b"))
            tiles = self.grown(tiles, self.verify(self.bounded(pairs if turn else pairs.unionByName(twos))))
        if not ROUNDS:
            tiles = self.grown(tiles, self.verify(self.bounded(twos)))
        tiles, _ = materialize(self.several(tiles), "join-open")
        if tiles.isEmpty():
            return
        self.grown(tiles, self.verify(self.compared(tiles)))

    def compared(self, tiles: DataFrame) -> DataFrame:
        """a, b: the pairs of different components in some tile that sizes and bitmaps leave.

        A tile of more than TILE classes is dealt to blocks, and its blocks meet two by two, each in a group of its own."""
        sizes = tiles.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
        rows = tiles.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
        rows = rows.select("key", "cid", "n", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "cid", "n", "comp").join(self.signatures.select("cid", "bits"), "cid")
        percent = self.percent

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept: pd.DataFrame | None = None

            def pairs(rows: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
                cid, n, comp, own = (rows[c].to_numpy(np.int64) for c in ("cid", "n", "comp", "own"))
                one = rows["low"].to_numpy() == rows["high"].to_numpy()
                bits, found = rows["bits"].tolist(), []
                for a, b in groups:
                    width = min(len(x) for x in bits[a:b])
                    signs = np.stack([x.view(np.uint64) if len(x) == width else np.bitwise_or.reduce(x.view(np.uint64).reshape(-1, width)) for x in bits[a:b]])
                    for i in range(a, b - 1):
                        rest = slice(i + 1, b)
                        fits = (comp[rest] != comp[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))
                        if not one[i]:
                            fits &= own[rest] != own[i]
                        j = np.flatnonzero(fits) + i + 1
                        if len(j):
                            mine, theirs = signs[i - a], signs[j - a]
                            common = np.minimum(n[i] - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64), n[j] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64))
                            j = j[100 * common >= percent * (n[i] + n[j] - common)]
                            found.append(np.stack([np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])], axis=1))
                return pd.DataFrame(np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64), columns=["a", "b"])

            for batch in batches:
                rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
                names = rows[["key", "low", "high"]].to_numpy(np.int64)
                edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist()]
                kept = rows.iloc[edges[-1] :].reset_index(drop=True)
                yield pairs(rows, list(zip(edges[:-1], edges[1:])))
            if kept is not None:
                yield pairs(kept, [(0, len(kept))])

        met = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").select("key", "low", "high", "own", "cid", "n", "comp", "bits")
        return met.mapInPandas(run, "a long, b long").distinct()

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id, class_id."""
        classes = self.classes.withColumn("component", F.col("cid"))
        if self.links is not None:
            comp = connected_components(self.links, cut=lambda df: materialize(df, "join-stars")[0]).select(F.col("node").alias("cid"), "component")
            classes = self.classes.join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        lows = classes.groupBy("component").agg(F.min("low").alias("component_id"))
        named = classes.join(lows, "component").select("k1", "k2", "component_id", F.col("cid").alias("class_id"), F.col("component").alias("group"))
        return self.members.join(named, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class_id", "group", F.col("uid").alias("row"), "th")


def join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), class_id (the same for equal sets), group (a
    number of the component), row (a number that each row has alone) and th (xxhash64 of the text)."""

    def steps() -> DataFrame:
        work = Join(docs, n, percent)
        work.link()
        return work.result()

    return build(docs.sparkSession, "join-result", steps)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")
