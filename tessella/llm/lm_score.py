"""Scoring of documents by masked pseudo-likelihood, with a small bidirectional window network in numpy.

The network predicts each token from the SIDE tokens before it and the SIDE after it: their embeddings,
weighted by place, are summed, go through one hidden layer, and give the token's cluster and then the token's slot
within it (two softmaxes of 64 instead of one of 4096).  Words share slots by hash; a word's probability is its slot's
times its share of the slot's occurrences, counted over the whole corpus: each word that makes up LEAST_SHARE of the
corpus has its own, the others of a slot have equal parts of what is left.  So the network has one size at any corpus
size, what is counted grows with the corpus, and what every task holds has at most 1 / LEAST_SHARE entries.  A
document's score is the sum over its tokens of the log-probability of each given both sides, and the mean of it.

Training covers all tokens of all documents.  Texts are dealt to shards by a hash of the text, of about SHARD tokens
each; equal texts are one, weighted by their number, so that no text can fill a shard by its copies, and a very long
text is dealt in parts.  A shard goes through its texts in the order of their hashes, with Adagrad; the shards of a
round start from the same weights, which are then averaged by number of tokens in a fixed order.  Scores so do
not depend on how the table is split, nor on which task is run again.  The rounds are disjoint and together all shards.

Null and empty texts, and texts of white space, have no tokens and score 0 with a null mean.  Repeated rows score
alike; very long texts are read whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import build, ids_as_text, materialize, mix64, mixed, read_table, stacked, with_columns_kept

VOCABULARY = 4096
CLUSTERS = 64
SIDE = 3
WIDTH = 24
HIDDEN = 32
ROUNDS = 4
RATE = 0.2
#: Tokens that go through the network together.
BATCH = 4096
#: Tokens a scoring step holds at once; longer documents take several steps.
STEP = 16_384
#: Tokens of a shard, about, and of a part of a long text.
SHARD, PART = 1_000_000, 65_536
#: Words that are at least so much of all have a probability of their own.
LEAST_SHARE = 1e-6
#: Characters that are hashed together, but for a longer word.
CHARS = 32_768
#: Different words that a task counts before it passes them on, about.
COUNTED = 2_000_000
SHAPES = {
    "embedding": (VOCABULARY + 1, WIDTH),
    "place": (2 * SIDE, WIDTH),
    "hidden": (WIDTH, HIDDEN),
    "hidden_bias": (HIDDEN,),
    "cluster": (HIDDEN, CLUSTERS),
    "cluster_bias": (CLUSTERS,),
    "member": (CLUSTERS, HIDDEN, VOCABULARY // CLUSTERS),
    "member_bias": (CLUSTERS, VOCABULARY // CLUSTERS),
}
#: Weights are averaged in blocks of this many numbers.
BLOCK = 4096
#: Weights of about so many shards are averaged at once.
FAN_IN = 64
PAD = VOCABULARY
OFFSETS = [k for k in range(2 * SIDE + 1) if k != SIDE]


@cache
def characters() -> np.ndarray:
    """A number for each character, 0 for white space."""
    out = mix64(np.arange(1, sys.maxunicode + 2, dtype=np.uint64))
    out[[c for c in range(0x10000) if chr(c).isspace()]] = 0
    return out


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number, and their inverses, modulo 2 to the 64."""
    bases = (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    out = [np.multiply.accumulate(np.full(n, b, np.uint64)) for b in bases]
    return out[0], out[1]


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all the texts, lower-cased, and where each text begins, with the end of the last.

    A word's hash is the sum of its characters' numbers times the powers of its places, mixed; a block of texts is
    multiplied by the powers of its own places, and each word's sum by the inverse of where the word begins."""
    lower = [t.lower() if isinstance(t, str) else "" for t in texts]
    codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    found, places, low, size = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0, CHARS
    while low < len(codes):
        x = characters().take(codes[low : low + size])
        space = x == 0
        if low + size < len(codes):  # up to the last word's end, or on to the end of a very long word
            if not space.any():
                size *= 2
                continue
            end = len(x) - int(space[::-1].argmax())
            x, space = x[:end], space[:end]
        begins = ~space
        begins[1:] &= space[:-1]
        first = np.flatnonzero(begins)
        if len(first):
            up, down = powers(size)
            x *= up[: len(x)]
            h = np.add.reduceat(x, first)
            h *= down[first]
            found.append(mixed(h))
            places.append(first + low)
        low, size = low + len(x), CHARS
    ends = np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + 1)
    return np.concatenate(found), np.concatenate([[0], np.searchsorted(np.concatenate(places), ends)]).astype(np.int64)


def slots(hashes: np.ndarray) -> np.ndarray:
    """Equal words get equal slots in every process."""
    return (hashes & np.uint64(VOCABULARY - 1)).astype(np.int16)


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The parts one after the other with SIDE paddings around each, and where each begins."""
    pad, out, at, starts = np.full(SIDE, PAD, np.int16), [np.full(SIDE, PAD, np.int16)], SIDE, []
    for x in parts:
        starts.append(at)
        out += [x, pad]
        at += len(x) + SIDE
    return np.concatenate(out), np.asarray(starts, np.int64)


class Network:
    def __init__(self, weights: np.ndarray | None = None, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.w: dict[str, np.ndarray] = {}
        at = 0
        for name, shape in SHAPES.items():
            size = int(np.prod(shape))
            if weights is not None:
                self.w[name] = weights[at : at + size].reshape(shape).astype(np.float32).copy()
            elif name == "place":
                self.w[name] = np.full(shape, 0.5, np.float32)
            elif name.endswith("bias"):
                self.w[name] = np.zeros(shape, np.float32)
            else:
                self.w[name] = (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32) * (0.3 if name == "embedding" else 1)
            at += size
        self.squares: dict[str, np.ndarray] | None = None

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[n].ravel() for n in SHAPES])

    def forward(self, sequence: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings of a padded sequence; sums over the surroundings of the chosen places, counted from SIDE on; the hidden layer."""
        w, n = self.w, len(sequence) - 2 * SIDE
        vectors = w["embedding"].take(sequence, axis=0)
        mixed = vectors[OFFSETS[0] : OFFSETS[0] + n] * w["place"][0]
        more = np.empty_like(mixed)
        for k, at in enumerate(OFFSETS[1:], 1):
            np.multiply(vectors[at : at + n], w["place"][k], out=more)
            mixed += more
        if len(chosen) < n or n and (chosen[1:] < chosen[:-1]).any():
            mixed = mixed.take(chosen, axis=0)
        h = mixed @ w["hidden"]
        h += w["hidden_bias"]
        return vectors, mixed, np.tanh(h, out=h)

    @staticmethod
    def by_cluster(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of the rows by the target's cluster, and (cluster, low, high) in it."""
        cluster = (target // (VOCABULARY // CLUSTERS)).astype(np.int16)
        order = np.argsort(cluster, kind="stable")
        edges = np.searchsorted(cluster[order], np.arange(CLUSTERS + 1))
        return order, [(c, a, b) for c, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if a < b]

    def logits(self, h: np.ndarray, parts: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the clusters, and of the slots within each row's cluster; rows in order of their clusters."""
        w = self.w
        inner = np.empty((len(h), VOCABULARY // CLUSTERS), np.float32)
        for c, low, high in parts:
            own = inner[low:high]
            np.matmul(h[low:high], w["member"][c], out=own)
            own += w["member_bias"][c]
        outer = h @ w["cluster"]
        outer += w["cluster_bias"]
        return outer, inner

    def moderate(self) -> bool:
        """Whether no score can be so large that its exponential overflows; the hidden layer lies between -1 and 1."""
        w = self.w
        return max(float((np.abs(w[n]).sum(axis=-2) + np.abs(w[f"{n}_bias"])).max()) for n in ("cluster", "member")) < 60

    @staticmethod
    def log_share(x: np.ndarray, at: np.ndarray, moderate: bool) -> np.ndarray:
        """The log of the softmax at one place of each row, whatever rows are beside it; x is changed."""
        if not moderate:
            x -= x.max(axis=1, keepdims=True)
        own = x[np.arange(len(x)), at]
        # Not as a product with ones: that rounds a row's sum by the row's place among the others.
        return own - np.log(np.einsum("ij->i", np.exp(x, out=x)))

    @staticmethod
    def error(x: np.ndarray, at: np.ndarray, scale: np.ndarray, moderate: bool) -> np.ndarray:
        """The softmax less one at one place of each row, times the row's scale, in x itself."""
        if not moderate:
            x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        x *= (scale / (x @ np.ones(x.shape[1], np.float32)))[:, None]
        x[np.arange(len(x)), at] -= scale
        return x

    def log_probabilities(self, sequence: np.ndarray) -> np.ndarray:
        """Of each slot of a padded sequence given its surroundings; of paddings 0."""
        size = VOCABULARY // CLUSTERS
        inside = sequence[SIDE:-SIDE]
        chosen = np.flatnonzero(inside != PAD)
        out = np.zeros(len(inside), np.float32)
        if len(chosen):
            order, parts = self.by_cluster(inside[chosen])
            chosen = chosen[order]
            wanted = inside[chosen].astype(np.int64)
            outer, inner = self.logits(self.forward(sequence, chosen)[2], parts)
            moderate = self.moderate()
            out[chosen] = self.log_share(outer, wanted // size, moderate) + self.log_share(inner, wanted % size, moderate)
        return out

    def moved(self, name: str, g: np.ndarray, at: object = slice(None)) -> None:
        """One step of Adagrad along a gradient, at some places of a weight."""
        if isinstance(at, slice):
            squares, room = self.squares[name], self.room[name]
        else:
            squares, room = self.squares[name][at], self.room[name][: len(g)]
        np.multiply(g, g, out=room)
        squares += room
        if not isinstance(at, slice):
            self.squares[name][at] = squares
        np.sqrt(squares, out=room)
        np.divide(g, room, out=room)
        room *= RATE
        if isinstance(at, slice):
            self.w[name] -= room
        else:
            self.w[name][at] -= room

    def learn(self, sequence: np.ndarray, weight: np.ndarray | None = None) -> None:
        """One step on the mean negative log-probability of a padded sequence's slots, weighted if asked for."""
        w, size, n = self.w, VOCABULARY // CLUSTERS, len(sequence) - 2 * SIDE
        if self.squares is None:
            self.squares = {k: np.full(v.shape, 1e-4, np.float32) for k, v in w.items()}
            self.room = {k: np.empty(v.shape, np.float32) for k, v in w.items()}
        inside = sequence[SIDE:-SIDE]
        chosen = np.flatnonzero(inside != PAD if weight is None else (inside != PAD) & (weight > 0))
        if not len(chosen):
            return
        order, parts = self.by_cluster(inside[chosen])
        chosen = chosen[order]
        target = inside[chosen].astype(np.int64)
        scale = np.ones(len(chosen), np.float32) if weight is None else weight[chosen].astype(np.float32)
        scale /= scale.sum()
        vectors, mixed, h = self.forward(sequence, chosen)
        moderate = self.moderate()
        outer, inner = self.logits(h, parts)
        outer, inner = self.error(outer, target // size, scale, moderate), self.error(inner, target % size, scale, moderate)
        dz = outer @ w["cluster"].T
        members, biases, ones = np.empty((len(parts), HIDDEN, size), np.float32), np.empty((len(parts), size), np.float32), np.ones(len(chosen), np.float32)
        for k, (c, low, high) in enumerate(parts):
            own = inner[low:high]
            dz[low:high] += own @ w["member"][c].T
            np.matmul(h[low:high].T, own, out=members[k])
            np.matmul(ones[low:high], own, out=biases[k])
        dz *= 1 - h * h
        spread = np.zeros((n, WIDTH), np.float32)
        spread[chosen] = dz @ w["hidden"].T
        places, back, more = np.empty((2 * SIDE, WIDTH), np.float32), np.zeros((len(sequence), WIDTH), np.float32), np.empty_like(spread)
        for k, at in enumerate(OFFSETS):
            places[k] = np.einsum("ij,ij->j", vectors[at : at + n], spread)
            np.multiply(spread, w["place"][k], out=more)
            back[at : at + n] += more
        ranked = np.argsort(sequence, kind="stable")
        ordered = sequence[ranked]
        first = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1])
        self.moved("embedding", np.add.reduceat(back.take(ranked, axis=0), first, axis=0), ordered[first].astype(np.int64))
        self.moved("place", places)
        self.moved("hidden", mixed.T @ dz)
        self.moved("hidden_bias", ones @ dz)
        self.moved("cluster", h.T @ outer)
        self.moved("cluster_bias", ones @ outer)
        touched = slice(None) if len(parts) == CLUSTERS else np.asarray([c for c, _, _ in parts])
        self.moved("member", members, touched)
        self.moved("member_bias", biases, touched)


class Shares(NamedTuple):
    """Log shares of words among those of their slot: of frequent words, by sorted hash, and of any other word of a slot."""

    hashes: np.ndarray
    logs: np.ndarray
    others: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = self.others[slots(hashes)]
        if len(self.hashes):
            order = np.argsort(hashes)  # words in order are found much faster
            ranked = hashes[order]
            at = np.minimum(np.searchsorted(self.hashes, ranked), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == ranked)
            out[order[hit]] = self.logs[at[hit]]
        return out


def read(docs: DataFrame) -> DataFrame:
    """Parts of texts (key, part, ids: slots with their surroundings, before and after: how many of these are surroundings
    only, n: the others) and counts of words (word, n), from one pass over the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "part", "ids", "before", "after", "word", "n"]
        words, times, held = [], [], 0

        def counted() -> tuple:
            unique, back = np.unique(np.concatenate(words), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate(times), minlength=len(unique)).astype(np.int64)
            words.clear(), times.clear()
            return (None, None, None, None, None, unique.view(np.int64), n)

        for batch in batches:
            texts = batch["text"].tolist()
            hashes, starts = hashed(texts)
            ids, parts = slots(hashes), []
            for text, a, b in zip(texts, starts[:-1].tolist(), starts[1:].tolist()):
                for low in range(a, b, PART):
                    high = min(b, low + PART)
                    first, last = max(a, low - SIDE), min(b, high + SIDE)
                    parts.append((xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")), (low - a) // PART, [ids[first:last].tobytes()], low - first, last - high, None, high - low))
            if len(hashes):
                unique, n = np.unique(hashes, return_counts=True)
                words.append(unique)
                times.append(n)
                held += len(unique)
            yield stacked(names, parts)
            if held > COUNTED:
                yield stacked(names, [counted()])
                held = 0
        if words:
            yield stacked(names, [counted()])

    return docs.select("text").mapInPandas(run, "key binary, part int, ids binary, before int, after int, word long, n long")


def shares_of(counts: DataFrame) -> Shares:
    """counts: word, n.  The frequent words, of which there are 1 / LEAST_SHARE at most, and a row for each slot reach the driver."""
    counts, _ = materialize(counts.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") >= LEAST_SHARE * total
    slot = F.col("word").bitwiseAND(F.lit(VOCABULARY - 1)).cast("int")
    by_slot = counts.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n"), F.sum(F.when(~frequent, F.col("n"))).alias("rest"), F.count_if(~frequent).alias("kinds")).toPandas()
    whole, others = np.ones(VOCABULARY), np.zeros(VOCABULARY, np.float32)
    at = by_slot["slot"].to_numpy(np.int64)
    whole[at] = by_slot["n"]
    # A word that was never counted is one more of the others.
    rest, kinds = by_slot["rest"].fillna(0).to_numpy(float), by_slot["kinds"].to_numpy(float)
    others[at] = np.log(np.maximum(rest, 0.5) / np.maximum(kinds, 1) / whole[at])
    own = counts.where(frequent).toPandas()
    hashes = own["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    logs = np.log(own["n"].to_numpy(float) / whole[(hashes & np.uint64(VOCABULARY - 1)).astype(np.int64)])
    return Shares(hashes[order], logs[order].astype(np.float32), others)


def train_round(texts: DataFrame, weights: np.ndarray, share: int, shares: int) -> np.ndarray:
    """texts: shard, key, part, ids, before, after, n, copies.  The weights after a pass over one of the disjoint shares of the shards, averaged by their tokens."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "part"])
        net = Network(weights)
        sequence, starts = padded([np.frombuffer(x, np.int16) for x in rows["ids"]])
        weight = np.zeros(len(sequence), np.float32)
        for at, raw, before, after, copies in zip(starts.tolist(), rows["ids"], rows["before"], rows["after"], rows["copies"]):
            weight[at + before : at + len(raw) // 2 - after] = copies
        weight = weight[SIDE:-SIDE]
        for low in range(0, len(weight), BATCH):
            net.learn(sequence[low : low + BATCH + 2 * SIDE], weight[low : low + BATCH])
        flat = net.flat()
        blocks = [flat[k : k + BLOCK] for k in range(0, len(flat), BLOCK)]
        return pd.DataFrame({"block": range(len(blocks)), "place": int(key[0]), "tokens": int((rows["n"] * rows["copies"]).sum()), "weights": [b.tobytes() for b in blocks]})

    def averaged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        n = rows["tokens"].to_numpy(np.float64)
        mean = np.average(np.stack([np.frombuffer(raw, np.float32) for raw in rows["weights"]]).astype(np.float64), axis=0, weights=n)
        return pd.DataFrame({"block": [key[0]], "place": int(rows["place"].iloc[0]), "tokens": [int(n.sum())], "weights": [mean.astype(np.float32).tobytes()]})

    schema = "block int, place long, tokens long, weights binary"
    chosen = texts.where(F.col("shard") % shares == share)
    found, places = chosen.groupBy("shard").applyInPandas(run, schema), texts.agg(F.max("shard")).first()[0] or 0
    step = FAN_IN * shares
    while places >= step:  # by a tree, so that one task never averages a block of very many shards
        found = found.groupBy("block", F.floor(F.col("place") / step).alias("group")).applyInPandas(averaged, schema)
        step *= FAN_IN
    found = found.groupBy("block").applyInPandas(averaged, schema).toPandas().sort_values("block")
    return np.concatenate([np.frombuffer(raw, np.float32) for raw in found["weights"]]) if len(found) else weights


class Model(NamedTuple):
    weights: np.ndarray
    shares: Shares


def train(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """docs: text."""
    every, _ = materialize(read(docs), "lm-read")
    shares = shares_of(every.where("word is not null").select("word", "n"))
    texts = every.where("key is not null").groupBy("key", "part").agg(F.first("ids").alias("ids"), F.first("before").alias("before"), F.first("after").alias("after"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    texts, _ = materialize(texts, "lm-texts")
    shards = max(rounds, (texts.agg(F.sum("n")).first()[0] or 0) // SHARD)
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("key", "part"), F.lit(shards)))
    weights = Network().flat()
    for k in range(rounds):
        weights = train_round(dealt, weights, k, rounds)
    return Model(weights, shares)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over the tokens), mean_log_likelihood."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network(model.weights)
        for batch in batches:
            hashes, starts = hashed(batch["text"].tolist())
            n = np.diff(starts)
            sequence, places = padded([slots(hashes[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())])
            logs = np.zeros(len(sequence))
            for low in range(SIDE, len(sequence) - SIDE, STEP):
                high = min(low + STEP, len(sequence) - SIDE)
                logs[low:high] = net.log_probabilities(sequence[low - SIDE : high + SIDE])
            own = model.shares.of(hashes).astype(np.float64)
            total = [float(logs[p : p + k].sum() + own[a : a + k].sum()) for p, a, k in zip(places.tolist(), starts.tolist(), n.tolist())]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": n, "log_likelihood": total, "mean_log_likelihood": [t / k if k else None for t, k in zip(total, n.tolist())]})

    rows, kind = ids_as_text(docs.select("doc_id", "text"))
    return rows.mapInPandas(run, "doc_id string, n_tokens long, log_likelihood double, mean_log_likelihood double").withColumn("doc_id", F.col("doc_id").cast(kind))


def score_documents(docs: DataFrame) -> DataFrame:
    kept = with_columns_kept(docs, "doc_id", "text")
    return build(docs.sparkSession, "lm-scores", lambda: score(kept, train(kept.select("text"))))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))
