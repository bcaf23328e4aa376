"""Benchmark decontamination with template canonicalisation.

Words are lower-cased and stripped of punctuation; numbers, units and names become typed placeholders
(<number>, <unit>, <name>: a capitalised word inside a sentence).  A text's template windows are the runs
of WINDOW canonical words; a document's windows meet a benchmark item's by hash.  A document that has at least
SIMILARITY of an item's windows is lined up with it: windows that lie at the same distance in both texts, or up
to DRIFT words further or nearer, are one alignment.  If an alignment meets at least SIMILARITY of the item's windows
and their slots, each window compared where it was met, are filled consistently (the same value of the item by the
same value of the document, different values by different ones), the item leaked: word for word, or with its
numbers, names and units replaced.  Slots that conflict acquit a document unless LITERAL of the windows are the same
word for word.

The windows of a document are met as a set, so that a text of thousands of numbers, which are all one symbol, gives
one row for each item; what meets where is counted by shifts, in stretches of the text, when the two are lined up.

Items of fewer words than a window are compared as a whole, as one window.  Null or empty texts match
nothing.  Repeated rows are reported once for each document id and item, of texts with one id the fullest leak; items
with one id and other texts are looked for one by one; very long texts are read whole.  Extra columns are ignored;
with an empty table on either side the result is empty.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import ids_as_text, materialize, mix64, read_table, sized, slices, stacked, window_hashes, with_columns_kept

WINDOW = 5
SIMILARITY = 0.8
#: So many of an item's windows word for word are a leak whatever its slots hold.
LITERAL = 0.9
#: How far apart alignments may lie and still count as one: words put in or left out in between.
DRIFT = 8
#: Windows of the benchmark, 16 bytes each, that are sent to every task; beyond it both sides are joined by a shuffle.
SENT_WINDOWS = 1_000_000
WORD_CACHE = 200_000
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(%|st|nd|rd|th)?")
#: Units of measure.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces t ton tons tonne tonnes ml l litre litres liter liters gal gallon gallons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv a ma j kj cal kcal k °c °f celsius fahrenheit percent % $ € £ usd eur gbp dollar dollars euro euros cent cents".split()
)
#: Matches of one item with one document that are held at once, about.
MATCHES = 2_000_000
ENDS = frozenset((".", "!", "?", ":", ""))
PUNCTUATION = string.punctuation.replace("%", "").replace("$", "") + "“”„‘’«»…–—¿¡"
NUMBER_ID, UNIT_ID, NAME_ID = (xxhash.xxh3_64_intdigest(x) for x in ("<number>", "<unit>", "<name>"))


def canonical(words: list[str]) -> tuple[list[int], list[int], list[bool], list[bool]]:
    """Of each word: hash of the canonical word, hash of the word itself, whether it may be a name, whether a sentence ends with it."""
    bare = [w.strip(PUNCTUATION) for w in words]
    low = [w.casefold() for w in bare]
    own = list(map(xxhash.xxh3_64_intdigest, low))
    canon, upper = own.copy(), [w[:1].isupper() for w in bare]
    for k in [k for k, w in enumerate(bare) if not w.isalpha() or low[k] in UNITS]:
        kind = NUMBER_ID if NUMBER.fullmatch(bare[k]) else UNIT_ID if low[k] in UNITS else None
        if kind is not None:
            canon[k], upper[k] = kind, False
    return canon, own, upper, [w.rstrip("\"'”’)»")[-1:] in ENDS for w in words]


class Templates:
    """Canonical words of texts; keeps what it knows about words from text to text."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.tables = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, bool))

    def read_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(canonical words, words themselves) of all the texts as 64-bit hashes, one text after the other, and where each
        text begins, with the end of the last; words of punctuation alone are left out."""
        if len(self.known) > WORD_CACHE:
            self.__init__()
        known = self.known
        split = [t.split() for t in texts]
        words = list(chain.from_iterable(split))
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]).astype(np.int64)
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            self.tables = tuple(np.concatenate([old, np.asarray(new, old.dtype)]) for old, new in zip(self.tables, canonical(fresh)))
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        canon, own, name, ends = (t[at] for t in self.tables)
        name[1:] &= ~ends[:-1]
        name[starts[:-1][starts[:-1] < len(name)]] = False
        canon[name] = NAME_ID
        real = own != EMPTY_ID
        return canon[real], own[real], np.concatenate([[0], np.cumsum(real)])[starts]

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.read_all([text])[:2]


EMPTY_ID = np.uint64(xxhash.xxh3_64_intdigest(""))


def width_of(canon: np.ndarray) -> int:
    """Words in an item's windows."""
    return min(WINDOW, len(canon))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, item (its row), hash, times (it occurs in the item), n_windows, width: the distinct windows of every item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Templates()
        for batch in batches:
            parts = []
            for item_id, item, text in zip(batch["item_id"], batch["item"], batch["text"]):
                canon = reader.read(text)[0] if isinstance(text, str) else np.empty(0, np.uint64)
                if len(canon):
                    h, times = np.unique(window_hashes(canon, width_of(canon)), return_counts=True)
                    parts.append((item_id, int(item), h.view(np.int64), times, int(times.sum()), width_of(canon)))
            yield stacked(["item_id", "item", "hash", "times", "n_windows", "width"], parts)

    return benchmark.mapInPandas(run, "item_id string, item long, hash long, times int, n_windows int, width int")


def document_windows(docs: DataFrame, wanted: np.ndarray | None, words: np.ndarray | None, widths: list[int]) -> DataFrame:
    """doc_id, row, hash: the distinct windows of every document, only those among `wanted` if it is given.

    words: the canonical words of all items; a window with any other word isn't wanted, and isn't hashed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Templates()
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            doc_ids, rows = batch["doc_id"].to_numpy(object), batch["row"].to_numpy(np.int64)
            parts = []
            for low, high in slices(texts):
                canon, _, starts = reader.read_all(texts[low:high])
                of = np.repeat(np.arange(low, high), np.diff(starts))
                among = np.ones(len(canon), bool) if words is None else words[np.minimum(np.searchsorted(words, canon), len(words) - 1)] == canon
                before = np.concatenate([[0], np.cumsum(among)])
                for width in widths:
                    at = np.flatnonzero(before[width:] - before[:-width] == width) if len(canon) >= width else np.empty(0, np.int64)
                    at = at[of[at] == of[at + width - 1]]
                    h = np.zeros(len(at), np.uint64)
                    for k in range(width):
                        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + canon[at + k])
                    if wanted is not None:
                        hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
                        at, h = at[hit], h[hit]
                    found = pd.DataFrame({"k": of[at], "hash": h.view(np.int64)}).drop_duplicates()
                    k = found["k"].to_numpy()
                    parts.append((doc_ids[k], rows[k], found["hash"].to_numpy()))
            yield stacked(["doc_id", "row", "hash"], parts)

    return docs.mapInPandas(run, "doc_id string, row long, hash long")


def matches(item: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(shift, place in the item) of all equal windows of the item and of the document's windows low .. high - 1."""
    order = np.argsort(item, kind="stable")
    own = doc[low:high]
    first = np.searchsorted(item, own, "left", sorter=order)
    n = np.searchsorted(item, own, "right", sorter=order) - first
    p = np.repeat(np.arange(len(own)), n)
    a = order[np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + first[p]]
    return p + low - a, a


def consistent(item: tuple[np.ndarray, np.ndarray], doc: tuple[np.ndarray, np.ndarray], at: np.ndarray, shift: np.ndarray) -> tuple[int, bool]:
    """at, shift: places of the matched windows and each one's own shift.  (slots that line up, whether their values map one to one)."""
    canon, own = item
    k = at[:, None] + np.arange(width_of(canon))
    slot = np.isin(canon[k], np.asarray([NUMBER_ID, UNIT_ID, NAME_ID], np.uint64))
    pairs = set(zip(own[k[slot]].tolist(), doc[1][(k + shift[:, None])[slot]].tolist()))
    return len(np.unique(k[slot])), len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)


def leaked(item: tuple[np.ndarray, np.ndarray], doc: tuple[np.ndarray, np.ndarray], least: float) -> tuple[int, int] | None:
    """(windows met, slots) of the first alignment, from the fullest on, that meets at least so many of the item's windows
    and whose slots are filled consistently, or of which LITERAL of the windows are the same word for word.

    An alignment is a shift with those up to DRIFT away; a window met at several of them takes the nearest, or the one
    at which most words are the same.  Shifts are looked at in stretches, so that memory is bounded on long texts."""
    width = width_of(item[0])
    mine, theirs = window_hashes(item[0], width), window_hashes(doc[0], width)
    m, span = len(mine), np.arange(width)
    step = max(1024, MATCHES // m)
    for base in range(1 - m, len(theirs), step):
        s, a = matches(mine, theirs, max(0, base - DRIFT), min(len(theirs), base + step + DRIFT + m))
        order = np.argsort(s, kind="stable")
        s, a = s[order], a[order]
        centres, counts = np.unique(s, return_counts=True)
        lows, highs = np.searchsorted(s, centres - DRIFT, "left"), np.searchsorted(s, centres + DRIFT, "right")
        able = (highs - lows >= least) & (centres >= base) & (centres < base + step)
        for k in np.flatnonzero(able)[np.argsort(-counts[able], kind="stable")].tolist():
            near, at = s[lows[k] : highs[k]], a[lows[k] : highs[k]]
            n = len(np.unique(at))
            if n < least:
                continue
            same = (item[1][at[:, None] + span] == doc[1][(at + near)[:, None] + span]).sum(axis=1)
            away = np.abs(near - centres[k])
            for by in (np.lexsort((away, at)), np.lexsort((away, -same, at))):
                own = by[np.unique(at[by], return_index=True)[1]]
                slots, fine = consistent(item, doc, at[own], near[own])
                if fine or (same[own] == width).sum() >= LITERAL * m:
                    return n, slots
            own = away == 0
            if own.sum() >= least:
                slots, fine = consistent(item, doc, at[own], near[own])
                if fine:
                    return int(own.sum()), slots
    return None


def verified(hits: DataFrame) -> DataFrame:
    """hits: doc_id, row, item_id, n_windows, doc_text, item_text; leaks with their evidence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Templates()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                best = leaked(reader.read(r.item_text), reader.read(r.doc_text), SIMILARITY * r.n_windows)
                if best:
                    rows.append((r.doc_id, r.row, r.item_id, best[0], r.n_windows, best[0] / r.n_windows, best[1]))
            yield pd.DataFrame(rows, columns=["doc_id", "row", "item_id", "n_matched", "n_windows", "similarity", "n_slots"])

    return hits.select("doc_id", "row", "item_id", "n_windows", "doc_text", "item_text").mapInPandas(run, "doc_id string, row long, item_id string, n_matched int, n_windows int, similarity double, n_slots int")


def row_key() -> Column:
    """Of a document's id and text: rows with the same id and other texts are other documents."""
    return F.xxhash64(F.col("doc_id").cast("string"), "text")


def leaked_rows(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, str, str]:
    """doc_id and item_id as text, row (the document's key) and the evidence; the types of the ids."""
    items, item_kind = ids_as_text(with_columns_kept(benchmark, "item_id", "text"), "item_id")
    items = items.select("item_id", "text", F.xxhash64("item_id", "text").alias("item")).where("text is not null").distinct()
    own, _ = materialize(item_windows(items), "benchmark-windows")
    n = own.count()
    widths = sorted({WINDOW, *(r.width for r in own.select("width").distinct().collect())})
    wanted = words = None
    if n <= SENT_WINDOWS:
        wanted = np.unique(np.append(own.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64).view(np.uint64), np.uint64(0)))
        words = np.unique(np.concatenate([np.zeros(1, np.uint64), *(Templates().read(r.text)[0] for r in items.select("text").collect())]))
        own = F.broadcast(own)
    kept, doc_kind = ids_as_text(with_columns_kept(docs, "doc_id", "text"))
    rows = kept.select("doc_id", row_key().alias("row"), "text")
    met = document_windows(rows, wanted, words, widths).join(own, "hash").groupBy("doc_id", "row", "item_id", "item", "n_windows").agg(F.sum("times").alias("met"))
    hits, _ = materialize(met.where(F.col("met") >= SIMILARITY * F.col("n_windows")).drop("met"), "benchmark-hits")
    asked = sized(hits.select("row").distinct(), "benchmark-rows")
    texts = rows.join(asked, "row", "left_semi").dropDuplicates(["doc_id", "row"]).select(F.col("doc_id").alias("of"), "row", F.col("text").alias("doc_text"))
    full = hits.join(texts.withColumnRenamed("row", "text_row"), (F.col("row") == F.col("text_row")) & F.col("doc_id").eqNullSafe(F.col("of"))).join(items.select("item", F.col("text").alias("item_text"), F.col("item_id").alias("its_id")), "item").where(F.col("item_id").eqNullSafe(F.col("its_id")))
    return materialize(verified(full), "benchmark-leaks")[0], doc_kind, item_kind


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, similarity, n_slots of each item that leaked into a document."""
    found, doc_kind, item_kind = leaked_rows(docs, benchmark)
    best = F.max(F.struct("similarity", "n_matched", "n_windows", "n_slots")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(F.col("doc_id").cast(doc_kind).alias("doc_id"), F.col("item_id").cast(item_kind).alias("item_id"), "best.n_matched", "best.n_windows", "best.similarity", "best.n_slots")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no item leaked."""
    gone = sized(leaked_rows(docs, benchmark)[0].select(F.col("row").alias("gone_row_key")).distinct(), "leaked")
    return docs.join(gone, row_key() == gone["gone_row_key"], "left_anti")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
