"""Removal of repeated byte strings with suffix arrays that are built by linear grouping.

Every byte goes that is covered by a string of LENGTH bytes that also starts anywhere else.

Which strings must be sorted together is found first.  Among the GRAM-byte grams of a string the one with
the least hash, the last of equals, is its anchor: all occurrences of a string have the same anchor at the
same place.  The strings of a text fall into runs with one anchor; a run's bytes, placed by the anchor, are a
context.  Contexts whose anchor hash occurs once hold no repeated string.  Different contexts of one anchor are cut into
blocks of BLOCK consecutive starts: the strings of a block have its core in common, so only blocks with equal
cores can hold equal strings.

Hashes only decide which strings are sorted together, and rows that are equal are left out beyond the second, which
can't change what is found.  What is removed is read off suffix arrays over the rows of many groups at once: of equal
contexts, a symbol each; of equal blocks alone with their core, likewise; of different blocks with equal cores,
whose columns that tell the same blocks apart are one symbol.  Suffixes are first grouped by their Lyndon prefixes,
in descending order of the groups, through pointers to the previous smaller suffix; then each group's order is
emitted from the smallest suffix on, without renaming and recursion (Baier, "Linear-time suffix sorting - a new
approach for suffix array construction").  The longest common prefix with a neighbour in that order tells how many
bytes from a place on occur in another row as well.

A group of over GROUP different blocks isn't gathered in one task: its blocks are contexts that are cut into narrower
blocks, in which fewer strings meet, down to blocks of one start, of which all that meet are equal.

Hashes have 64 bits; groups are met by two of them.  Null text counts as empty; texts of under LENGTH bytes
keep all their bytes.  Repeated rows are copies of each other.  Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import build, discard, materialize, mix64, read_table, stacked, with_columns_kept

LENGTH = 400
GRAM = 32
BLOCK = 32
GROUP = 5000
#: By so much blocks of a larger group are cut narrower.
NARROWER = 6
#: Symbols that are sorted together at most, but for a larger group.
SYMBOLS = 40_000
#: Texts are read in parts of so many bytes, each with LENGTH - 1 bytes of the next.
PART = 1 << 22


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes of a list of positive numbers in ascending order, by grouping."""
    s = [*text, 0]
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, link, size = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for k, i in enumerate(order):
        if s[i] != s[order[start]]:
            start = k
        place[i], link[i] = k, start
        size[start] += 1
    before = [-1] * n
    end = n
    while end:  # groups in descending order; a group's context grows to its suffixes' Lyndon prefix
        group = link[order[end - 1]]
        counts: dict[int, int] = {}
        for i in sorted(order[group:end]):
            p = i - 1
            while p >= 0 and link[p] >= group:
                p = before[p]
            before[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        end = group
        split: dict[int, dict[int, list[int]]] = {}
        for p, times in counts.items():
            split.setdefault(link[p], {}).setdefault(times, []).append(p)
        for old, by_times in split.items():
            top = old + size[old]
            for times in sorted(by_times, reverse=True):  # followed by the group more often: greater
                own = by_times[times]
                low = top - len(own)
                if low == old:
                    break
                for k, p in enumerate(own, low):
                    other, at = order[k], place[p]
                    order[k], order[at] = p, other
                    place[p], place[other] = k, at
                for k in range(low, top):
                    link[order[k]] = low
                size[low] = len(own)
                top = low
            size[old] = top - old
    out, free, done = [0] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not done[i]:
            done[i] = 1
            group = link[i]
            out[free[group]] = i
            free[group] += 1
            i = before[i]
    return out[1:]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Of each suffix and the one before it in the order; the first has 0."""
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    out, h = [0] * n, 0
    for i in range(n):
        k = rank[i]
        if not k:
            h = 0
            continue
        j = order[k - 1]
        while i + h < n and j + h < n and text[i + h] == text[j + h]:
            h += 1
        out[k] = h
        h -= h > 0
    return out


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Of the GRAM bytes from each place on."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    words = np.empty(len(raw) - 7, np.uint64)
    for k in range(8):
        own = raw[k : k + (len(raw) - k) // 8 * 8].view("<u8")
        words[k::8] = own[: len(words[k::8])]
    h = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return h


def anchored_runs(raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, its hash, first and last start of the strings of which it is the anchor), for all strings of a text."""
    width = length - GRAM + 1
    h = gram_hashes(raw)
    n = len(h) - width + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 4
    keys = (h >> np.uint64(24) << np.uint64(24)) | (np.uint64((1 << 24) - 1) - np.arange(len(h), dtype=np.uint64))
    padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = keys
    rows = padded.reshape(-1, width)
    up = np.minimum.accumulate(rows, axis=1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(down[:n], up[width - 1 : width - 1 + n])
    anchor = np.int64((1 << 24) - 1) - (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return anchor[first], h[anchor[first]], first, last


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def contexts(docs: DataFrame, length: int) -> DataFrame:
    """tid (hash of the text), h (anchor's hash), c (context's hash), p (anchor), lo, hi (starts relative to it)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            parts = []
            for tid, text in zip(batch["tid"], batch["text"]):
                data = text.encode("utf-8", "surrogatepass")
                for base in range(0, max(1, len(data) - length + 1), PART):
                    part = data[base : base + PART + length - 1]
                    p, h, lo, hi = anchored_runs(np.frombuffer(part, np.uint8), length)
                    if not len(p):
                        continue
                    c = [signed(digest(part[a : b + length], seed=(m - a))) for m, a, b in zip(p.tolist(), lo.tolist(), hi.tolist())]
                    parts.append((tid, h.view(np.int64), np.asarray(c, np.int64), p + base, lo - p, hi - p))
            yield stacked(["tid", "h", "c", "p", "lo", "hi"], parts)

    return docs.select("tid", "text").mapInPandas(run, "tid binary, h long, c long, p long, lo int, hi int")


def with_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """h, c, lo, hi, data of the wanted contexts (h, c and where one occurs: rep)."""
    asked = wanted.groupBy(F.col("rep.tid").alias("tid")).agg(F.collect_list(F.struct("h", "c", "rep.p", "rep.lo", "rep.hi")).alias("asked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, own in zip(batch["text"], batch["asked"]):
                data = text.encode("utf-8", "surrogatepass")
                rows += [(x["h"], x["c"], x["lo"], x["hi"], data[x["p"] + x["lo"] : x["p"] + x["hi"] + length]) for x in own]
            yield pd.DataFrame(rows, columns=["h", "c", "lo", "hi", "data"])

    found = docs.select("tid", "text").join(asked, "tid").dropDuplicates(["tid"])
    return found.select("text", "asked").mapInPandas(run, "h long, c long, lo int, hi int, data binary")


def blocks(table: DataFrame, length: int, width: int, keep_data: bool) -> DataFrame:
    """table: h, c, copies, lo, hi (the first and last start), data; k1, k2 (anchor, block and core), b (hash of the block), h, c,
    copies, t (the block's first start), first, last (its own starts), data if asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows = []
            for h, c, copies, lo, hi, data in zip(*(batch[x] for x in ("h", "c", "copies", "lo", "hi", "data"))):
                for t in range(lo // width * width, hi + 1, width):
                    first, last = max(lo, t), min(hi, t + width - 1)
                    core = data[t + width - 1 - lo : t + length - lo]
                    own = data[first - lo : last + length - lo]
                    seed = (h ^ (t * 0x9E3779B97F4A7C15)) & ((1 << 64) - 1)
                    row = (signed(digest(core, seed=seed)), h, signed(digest(own, seed=first - t + 1)), h, c, copies, t, first, last)
                    rows.append((*row, own) if keep_data else row)
            yield pd.DataFrame(rows, columns=["k1", "k2", "b", "h", "c", "copies", "t", "first", "last", *(["data"] if keep_data else [])])

    return table.select("h", "c", "copies", "lo", "hi", "data").mapInPandas(run, "k1 long, k2 long, b long, h long, c long, copies int, t int, first int, last int" + (", data binary" if keep_data else ""))


def group_rows(rows: list[tuple], length: int, width: int) -> tuple[list[list[int]], list[list[tuple[int, int]]], int]:
    """The rows (t, first, last, data) of one group as lists of symbols, the (start, width) of each symbol, and the count of symbols.

    Neighbouring columns that tell the same rows apart are one symbol; what a row lacks is unlike anything.  Without
    data the rows are known to differ, or there is but one: each is a symbol.
    """
    t, m, edge = rows[0][0], len(rows), width - 1
    if rows[0][3] is None:
        return [[k] for k in range(m)], [[(first, last + length - first)] for _, first, last, _ in rows], m
    table = np.empty((m, 2 * edge), np.int32)
    for k, (_, first, last, data) in enumerate(rows):
        raw = np.frombuffer(data, np.uint8)
        table[k] = 256 + k
        table[k, first - t : edge] = raw[: edge - (first - t)]
        tail = raw[t + length - first :]
        table[k, edge : edge + len(tail)] = tail
    if m <= 12:
        label = (table[:, None, :] == table[None, :, :]).argmax(axis=1)
    else:
        label = np.empty_like(table)
        for col in range(2 * edge):
            _, at, back = np.unique(table[:, col], return_index=True, return_inverse=True)
            label[:, col] = at[back]
    same = (label[:, 1:] == label[:, :-1]).all(axis=0)
    same[edge - 1] = False
    starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
    widths = np.diff(np.concatenate([starts, [2 * edge]]))
    n_left = int((starts < edge).sum())
    place = [*(t + starts[:n_left]).tolist(), t + edge, *(t + length + starts[n_left:] - edge).tolist()]
    wide = [*widths[:n_left].tolist(), length - edge, *widths[n_left:].tolist()]
    symbols = np.empty((m, len(place)), np.int64)
    own = label[:, starts]
    symbols[:, :n_left], symbols[:, n_left], symbols[:, n_left + 1 :] = own[:, :n_left], 0, own[:, n_left:]
    symbols += np.arange(len(place)) * m
    return symbols.tolist(), [list(zip(place, wide))] * m, m * len(place)


def covered(groups: list[list[tuple]], length: int, width: int) -> list[list[list[tuple[int, int]]]]:
    """groups: rows (t, first, last, data, copies).  For each row of each group: the stretches (from, to), relative to the
    anchor, of bytes in strings that another row, or a copy of the same, has too."""
    text: list[int] = []
    where: list[tuple[int, int, list[tuple[int, int]], int]] = []
    used = 1
    for g, rows in enumerate(groups):
        symbols, spans, n = group_rows([r[:4] for r in rows], length, width)
        ends = used + n
        for k, own in enumerate(symbols):
            where.append((g, k, spans[k], len(text)))
            for _ in range(rows[k][4]):
                text += [used + x for x in own]
                text.append(ends)
                ends += 1
        used = ends
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    most = [0] * len(text)
    for k, i in enumerate(order):
        most[i] = max(shared[k], shared[k + 1] if k + 1 < len(shared) else 0)
    out: list[list[list[tuple[int, int]]]] = [[[] for _ in rows] for rows in groups]
    for g, k, spans, base in where:
        _, first, last = groups[g][k][:3]
        for at, (start, _) in enumerate(spans):
            n = most[base + at]
            if n and start <= spans[0][0] + width - 1:
                end = spans[at + n - 1]
                low, high = max(start, first), min(end[0] + end[1], last + length)  # a copy lacks what its row lacks
                if high - low >= length:
                    out[g][k].append((low, high))
    return out


def sorted_groups(rows: DataFrame, length: int, width: int) -> DataFrame:
    """rows: k1, k2, b, copies (two at most), t, first, last, data; k1, k2, b, low, high: the covered stretches of each row."""
    names = ["k1", "k2", "b", "low", "high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[list[tuple]] = []
        groups: list[list[tuple]] = []
        key, size = None, 0

        def flush() -> pd.DataFrame:
            found = []
            for own, rows in zip(ids, covered(groups, length, width) if groups else []):
                for name, stretches in zip(own, rows):
                    found += [(*name, a, b) for a, b in stretches]
            ids.clear(), groups.clear()
            return pd.DataFrame(found, columns=names)

        for batch in batches:
            for k1, k2, b, copies, t, first, last, data in zip(*(batch[c] for c in ("k1", "k2", "b", "copies", "t", "first", "last", "data"))):
                if (k1, k2) != key:
                    if size > SYMBOLS:
                        yield flush()
                        size = 0
                    key = k1, k2
                    ids.append([])
                    groups.append([])
                ids[-1].append((k1, k2, b))
                groups[-1].append((t, first, last, data, copies))
                size += 2 * copies if data is None else 2 * min(width, len(groups[-1]) + 3) * copies
        yield flush()

    given = rows.select("k1", "k2", "b", F.least("copies", F.lit(2)).cast("int").alias("copies"), "t", "first", "last", "data")
    return given.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInPandas(run, "k1 long, k2 long, b long, low int, high int")


def found_in_blocks(table: DataFrame, length: int, width: int) -> DataFrame:
    """table: h, c, copies, lo, hi, data (distinct); h, c, low, high: the stretches that other contexts, or copies, have, too.

    Groups of over GROUP different blocks are cut into narrower blocks, in which fewer strings meet."""
    cut, cut_path = materialize(blocks(table, length, width, keep_data=False), "repeats-blocks")
    kinds = cut.groupBy("k1", "k2", "b").agg(F.sum("copies").alias("copies"), F.min(F.struct("h", "c", "t", "first", "last")).alias("one"))
    kinds, kinds_path = materialize(kinds, "repeats-kinds")
    groups = kinds.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("rows")).where("rows > 1").drop("rows")
    met, met_path = materialize(kinds.join(groups, ["k1", "k2"]).select("k1", "k2", "b", F.least("copies", F.lit(2)).cast("int").alias("copies"), "kinds", "one.*"), "repeats-met")
    discard(table.sparkSession, kinds_path)

    def with_data(some: DataFrame) -> DataFrame:
        asked = table.join(some.select("h", "c").distinct(), ["h", "c"], "left_semi")
        return blocks(asked, length, width, keep_data=True).drop("copies").join(some.select("k1", "k2", "b", "h", "c", "t", "copies"), ["k1", "k2", "b", "h", "c", "t"])

    names = ["k1", "k2", "b", "copies", "t", "first", "last", "data"]
    alone = met.where("kinds = 1").withColumn("data", F.lit(None).cast("binary")).select(*names)
    several = with_data(met.where(f"kinds > 1 and kinds <= {GROUP}")).select(*names)
    found, found_path = materialize(sorted_groups(alone.unionByName(several), length, width), "repeats-found")
    paths = [cut_path, met_path, found_path]
    large = met.where(f"kinds > {GROUP}")
    if not large.isEmpty():  # a block of a large group is a context of its own; blocks of one start have one kind a group
        own = with_data(large).select(F.xxhash64("k1", "k2").alias("h"), F.xxhash64("k1", "k2", "b").alias("c"), "copies", F.col("first").alias("lo"), F.col("last").alias("hi"), "data", "k1", "k2", "b")
        own, own_path = materialize(own, "repeats-large")
        deeper = found_in_blocks(own.drop("k1", "k2", "b"), length, max(1, width // NARROWER))
        found = found.unionByName(own.select("h", "c", "k1", "k2", "b").join(deeper, ["h", "c"]).select("k1", "k2", "b", "low", "high"))
        paths.append(own_path)
    out, _ = materialize(cut.join(found, ["k1", "k2", "b"]).select("h", "c", "low", "high").distinct(), "repeats-stretches")
    discard(table.sparkSession, *paths)
    return out


def repeated_stretches(texts: DataFrame, length: int) -> DataFrame:
    """texts: tid, text; tid and the stretches of bytes to remove (overlapping, of each distinct text once)."""
    spark = texts.sparkSession
    every, _ = materialize(contexts(texts, length), "repeats-contexts")
    rep = F.min(F.struct("tid", "p", "lo", "hi")).alias("rep")
    counted, counted_path = materialize(every.groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"), rep), "repeats-counted")
    groups = counted.groupBy("h").agg(F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("kinds")).where("rows > 1").select("h", "kinds")
    met, _ = materialize(counted.join(groups, "h"), "repeats-anchored")
    discard(spark, counted_path)
    same = met.where("copies > 1").select(F.col("h").alias("k1"), F.col("c").alias("k2"), F.col("c").alias("b"), "copies", F.col("rep.lo").alias("t"), F.col("rep.lo").alias("first"), F.col("rep.hi").alias("last"), F.lit(None).cast("binary").alias("data"))
    whole, _ = materialize(sorted_groups(same, length, BLOCK).select(F.col("k1").alias("h"), F.col("k2").alias("c"), "low", "high"), "repeats-whole")
    table, table_path = materialize(with_bytes(texts, met.where("kinds > 1").select("h", "c", "rep"), length).dropDuplicates(["h", "c"]).withColumn("copies", F.lit(1)), "repeats-bytes")
    part = found_in_blocks(table, length, BLOCK)
    discard(spark, table_path)
    # Written first, so that a context of very many texts can be split in the join.
    by_context, _ = materialize(whole.unionByName(part).groupBy("h", "c").agg(F.collect_set(F.struct("low", "high")).alias("own")), "repeats-by-context")
    return every.join(by_context, ["h", "c"]).select("tid", "p", F.explode("own").alias("x")).select("tid", (F.col("p") + F.col("x.low")).alias("low"), (F.col("p") + F.col("x.high")).alias("high")).distinct()


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (of removed bytes), kept (the bytes that stay)."""
    kept = with_columns_kept(docs, "doc_id", "text")
    kind = dict(kept.dtypes)["doc_id"]
    texts = kept.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.unhex(F.md5("text")))
    found = lambda: repeated_stretches(texts.where(F.octet_length("text") >= length), length).groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("cuts"))
    stretches = build(docs.sparkSession, "repeats-cuts", found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, cuts in zip(batch["doc_id"], batch["text"], batch["cuts"]):
                data = text.encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for x in cuts if cuts is not None else ():
                    if spans and x["low"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x["high"])
                    else:
                        spans.append([x["low"], x["high"]])
                at, left = 0, []
                for a, b in spans:
                    left.append(data[at:a])
                    at = b
                rest = b"".join([*left, data[at:]])
                rows.append((doc_id, len(data), len(data) - len(rest), len(spans), [{"low": a, "high": b} for a, b in spans], rest))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    out = texts.join(stretches, "tid", "left").select("doc_id", "text", "cuts").mapInPandas(run, "doc_id string, n_bytes long, n_removed long, n_spans long, spans array<struct<low: long, high: long>>, kept binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
