"""Language identification by unigram piece models that sum over all segmentations of a text.

The vocabulary is that of a public tokenizer and the same for every language; a language is a distribution
over its pieces.  The probability of a word is the sum, over all ways to cut it into pieces, of the product
of their probabilities, by the forward algorithm; a text's is the product over its words.  The distributions
are learnt by expectation-maximisation from the counts of all words of the labelled texts: forward-backward
gives each piece's expected count, which Spark sums by language and piece.

Probabilities are lifted by the same factor a character for all segmentations, and the sums of a word of any length
are brought back to one now and then, so that they never underflow; a word is never cut.

Null text, or text without a letter (Unicode's categories L; numerals such as fractions are none), gives `und` with
score 0, and so does any text where there is nothing to learn from.  Ties go to the language that sorts first.  A row
with null doc_id is learnt from like others (its id's text counts as empty).  Repeated rows count as often as they
occur; very long texts are read whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import ids_as_text, materialize, read_table, stacked, with_columns_kept

WORD = re.compile(r"[^\W\d_]+").findall
ROUNDS = 2
#: Expected count that each piece has to begin with, in each language, and the share that is spread over all pieces.
SMOOTHING, SPREAD = 0.05, 1e-4
#: Probability of a character that no piece covers; the same for all languages.
UNKNOWN = 1e-7
#: Every piece's probability is multiplied by this for each of its characters, which changes all segmentations of a
#: word alike; after SPAN characters the sums are brought back to one.  No piece is rarer than SPREAD of its share, so
#: that neither end of the numbers is reached in between.
LIFT, SPAN = 1e4, 48
#: A model for each language is held by every task, so their number has a bound.
MAX_LANGUAGES = 1000
WORD_CACHE = 400_000
#: Characters of the words whose lattices are held at once.
LATTICE_CHARS = 160_000


class Vocabulary:
    """The pieces as a trie whose steps are looked up for many words at once."""

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers as P
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or P.path("piece_bpe_32k.model"))
        pieces = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        self.pieces = pieces = sorted({p for p in pieces if p})
        self.size = len(pieces)
        self.longest = max(map(len, pieces))
        steps: dict[int, int] = {}  # (node, character) to node
        ends: dict[int, int] = {}
        inner: set[int] = set()
        for k, piece in enumerate(pieces):
            node = 0
            for c in piece:
                inner.add(node)
                node = steps.setdefault(node << 21 | ord(c), len(steps) + 1)
            ends[node] = k
        self.piece = np.full(len(steps) + 1, -1, np.int64)  # of a node
        self.piece[list(ends)] = list(ends.values())
        self.inner = np.zeros(len(steps) + 1, bool)
        self.inner[list(inner)] = True
        bits = max(10, (8 * len(steps)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.nodes = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
        keys, nodes = np.fromiter(steps, np.uint64, len(steps)) + np.uint64(1), np.fromiter(steps.values(), np.int64, len(steps))
        slot = self.slots(keys)
        while len(keys):  # the first for each slot stays, the others look one further on
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] == 0]
            self.keys[slot[first]], self.nodes[slot[first]] = keys[first], nodes[first]
            left = np.setdiff1d(np.arange(len(keys)), first)
            keys, nodes, slot = keys[left], nodes[left], slot[left] + np.uint64(1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes reached; 0 where there is none."""
        key = (node.astype(np.uint64) << np.uint64(21) | char) + np.uint64(1)
        slot = self.slots(key)
        found = self.keys[slot]
        out = np.where(found == key, self.nodes[slot], 0)
        at = np.flatnonzero((found != key) & (found != 0))
        while len(at):
            slot[at] = slot[at] + np.uint64(1) & self.mask
            found = self.keys[slot[at]]
            hit = found == key[at]
            out[at[hit]] = self.nodes[slot[at[hit]]]
            at = at[~hit & (found != 0)]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """All pieces that occur in some words, as edges between positions: word w has positions base[w] .. base[w] + length.

    Edges are in order of their source's place in its word, and of their length."""

    def __init__(self, words: list[str], vocab: Vocabulary) -> None:
        marked = ["▁" + w for w in words]
        self.length = length = np.fromiter(map(len, marked), np.int64, len(marked))
        chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        offset = np.concatenate([[0], np.cumsum(length)])
        self.base = offset[:-1] + np.arange(len(words))
        self.n = int(length.sum()) + len(words)
        word = np.repeat(np.arange(len(words)), length)
        place = np.arange(len(chars)) - offset[word]
        left = length[word] - place
        start, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        starts, sizes, ids = [], [], []
        for k in range(1, vocab.longest + 1):
            node = vocab.step(node, chars[start + (k - 1)])
            piece = vocab.piece[node]
            if k == 1:  # a character without a piece is an edge all the same
                piece = np.where(piece < 0, vocab.size, piece)
            hit = np.flatnonzero(piece >= 0)
            starts.append(start[hit])
            sizes.append(np.full(len(hit), k))
            ids.append(piece[hit])
            go = np.flatnonzero(vocab.inner[node] & (node > 0) & (left[start] > k))
            start, node = start[go], node[go]
            if not len(start):
                break
        start, self.size, self.piece = map(np.concatenate, (starts, sizes, ids))
        self.longest = vocab.longest
        level = place[start] * (vocab.longest + 1) + self.size
        if len(level) and level.max() < 1 << 15:
            level = level.astype(np.int16)
        order = np.argsort(level, kind="stable")
        start, level, self.size, self.piece = start[order], level[order], self.size[order], self.piece[order]
        self.word_of = word[start]
        self.source = start + self.word_of
        self.target = self.source + self.size
        self.groups = np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [len(level)]]).tolist() if len(level) else [0]
        self.place = place[start]

    def renewed(self, out: np.ndarray, words: np.ndarray, places: np.ndarray, logs: np.ndarray, at: int) -> None:
        """Divides the sums at some places of the words by their greatest, which is noted where it holds from."""
        where = self.base[words][:, None] + np.clip(places, 0, self.length[words][:, None])
        most = out[where].max(axis=1)
        out[where] /= most[:, None]
        logs[self.base[words] + at] = np.log(most)

    def sweep(self, p: np.ndarray, onward: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Sums over the ways from each word's start to each position, or from there to its end; and, if there are words of
        over SPAN characters, the logs of what the sums were divided by."""
        out = np.zeros((self.n, *p.shape[1:]))
        out[self.base if onward else self.base + self.length] = 1
        logs = np.zeros_like(out) if len(self.length) and self.length.max() > SPAN else None
        if onward:
            source, target, place, groups = self.source, self.target, self.place, self.groups
        else:
            place = self.place + self.size
            order = np.lexsort((self.size, -place))
            place, source, target, p = place[order], self.target[order], self.source[order], p[order]
            key = place * (self.longest + 1) + self.size[order]
            groups = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]).tolist() if len(key) else [0]
        done, near = None, np.arange(self.longest + 1)
        for a, b in zip(groups[:-1], groups[1:]):
            if logs is not None and (at := int(place[a])) % SPAN == 0 and at and at != done:
                done = at
                words = np.flatnonzero(self.length > at)
                if len(words):
                    self.renewed(out, words, at + near if onward else at - near, logs, at)
            out[target[a:b]] += out[source[a:b]] * p[a:b]
        if logs is not None:  # what was divided once holds for all places further on
            if onward:
                whole = np.cumsum(logs, axis=0)
                before = whole[self.base] - logs[self.base]
            else:
                whole = np.cumsum(logs[::-1], axis=0)[::-1]
                before = whole[self.base + self.length] - logs[self.base + self.length]
            logs = whole - np.repeat(before, self.length + 1, axis=0)
        return out, logs

    def forward(self, p: np.ndarray) -> np.ndarray:
        """p: probabilities of edges (by language, if two-dimensional); for words of up to SPAN characters."""
        return self.sweep(p, True)[0]

    def backward(self, p: np.ndarray) -> np.ndarray:
        return self.sweep(p, False)[0]

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[self.base + self.length]

    def lifted(self, p: np.ndarray) -> np.ndarray:
        by_size = LIFT ** np.arange(self.longest + 1)
        return p * (by_size[self.size] if p.ndim == 1 else by_size[self.size][:, None])

    def log_totals(self, p: np.ndarray) -> np.ndarray:
        """The log of each word's probability, by language."""
        alpha, logs = self.sweep(self.lifted(p), True)
        out = np.log(self.totals(alpha)) + (0 if logs is None else self.totals(logs))
        return out - np.log(LIFT) * (self.length if p.ndim == 1 else self.length[:, None])

    def posteriors(self, p: np.ndarray) -> np.ndarray:
        """Of each edge: the share of its word's probability that goes through it."""
        p = self.lifted(p)
        (alpha, la), (beta, lb) = self.sweep(p, True), self.sweep(p, False)
        total = self.totals(alpha)[self.word_of]
        out = alpha[self.source] * p * beta[self.target] / total
        return out if la is None else out * np.exp(la[self.source] + lb[self.target] - self.totals(la)[self.word_of])


def lattice_batches(words: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of the words that have about LATTICE_CHARS characters."""
    low, chars = 0, 0
    for k, w in enumerate(words):
        chars += len(w) + 1
        if chars >= LATTICE_CHARS:
            yield low, k + 1
            low, chars = k + 1, 0
    if low < len(words):
        yield low, len(words)


def letters_of(word: str) -> list[str]:
    """A word's runs of letters: among what counts as a word there are numerals that are no letters."""
    return [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n over all the texts, counted within each batch before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, Counter] = {}

        def rows() -> pd.DataFrame:
            parts = []
            for lang, c in own.items():
                for w in [w for w in c if not w.isalpha()]:
                    n = c.pop(w)
                    for x in letters_of(w):
                        c[x] += n
                if c:
                    parts.append((lang, list(c), list(c.values())))
            own.clear()
            return stacked(["lang", "word", "n"], parts)

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                if isinstance(text, str):
                    own.setdefault(lang, Counter()).update(WORD(text))
            if sum(map(len, own.values())) > WORD_CACHE:
                yield rows()
        yield rows()

    return texts.select("lang", "text").mapInPandas(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expectation(counts: DataFrame, table: np.ndarray | None, langs: list[str], vocab_path: str | None) -> np.ndarray:
    """One round: expected counts of the pieces by language from all words, and from them the new distributions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(vocab_path)
        total = np.zeros((vocab.size + 1) * len(langs))
        at = {lang: k for k, lang in enumerate(langs)}
        p_all = None if table is None else np.vstack([table, np.full((1, len(langs)), UNKNOWN)])
        for batch in batches:
            words = batch["word"].tolist()
            for low, high in lattice_batches(words):
                lattice = Lattice(words[low:high], vocab)
                part = batch.iloc[low:high]
                lang = part["lang"].map(at).to_numpy(np.int64)[lattice.word_of]
                p = np.where(lattice.piece == vocab.size, UNKNOWN, 1 / vocab.size) if p_all is None else p_all[lattice.piece, lang]
                weight = part["n"].to_numpy(float)[lattice.word_of]
                total += np.bincount(lang * (vocab.size + 1) + lattice.piece, weights=weight * lattice.posteriors(p), minlength=len(total))
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"slot": hit, "expected": total[hit]})

    summed = counts.mapInPandas(run, "slot long, expected double").groupBy("slot").agg(F.sum("expected").alias("expected")).toPandas()
    size = vocabulary(vocab_path).size
    out = np.zeros((size + 1) * len(langs))
    out[summed["slot"].to_numpy(np.int64)] = summed["expected"].to_numpy()
    by_piece = out.reshape(len(langs), size + 1)[:, :size].T + SMOOTHING
    return (1 - SPREAD) * by_piece / by_piece.sum(axis=0) + SPREAD / size


def fit(labelled: DataFrame, vocab_path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (pieces by languages: bounded by the vocabulary, not the corpus)."""
    counts, _ = materialize(word_counts(labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())), "language-words")
    langs = sorted(r.lang for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    table = None
    for _ in range(ROUNDS if langs else 0):
        table = expectation(counts, table, langs, vocab_path)
    return langs, table


class Scores:
    """Log probabilities of words by language, kept from task to task of one worker while the distributions are the same."""

    last: Scores | None = None

    def __init__(self, table: np.ndarray, vocab: Vocabulary) -> None:
        self.table, self.vocab = table, vocab
        self.p = np.vstack([table, np.full((1, table.shape[1]), UNKNOWN)])
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.logs, self.lettered = np.empty((0, self.p.shape[1])), np.empty(0, bool)

    @classmethod
    def of(cls, table: np.ndarray, vocab: Vocabulary) -> Scores:
        if cls.last is None or cls.last.vocab is not vocab or not np.array_equal(cls.last.table, table):
            cls.last = cls(table, vocab)
        return cls.last

    def learn(self, found: list[list[str]]) -> None:
        """Makes all the words known; words of numerals alone have no letters and log probability 0."""
        if len(self.known) > WORD_CACHE:
            self.clear()
        fresh = list(set().union(*found).difference(self.known))
        plain = [w for w in fresh if w.isalpha()]
        new = [self.logs, *(self.of_words(plain[low:high]) for low, high in lattice_batches(plain))]
        lettered = [self.lettered, np.ones(len(plain), bool)]
        mixed = [(w, letters_of(w)) for w in fresh if not w.isalpha()]
        for _, parts in mixed:
            new.append(self.of_words(parts).sum(axis=0, keepdims=True) if parts else np.zeros((1, self.p.shape[1])))
            lettered.append(np.asarray([bool(parts)]))
        self.logs, self.lettered = np.vstack(new), np.concatenate(lettered)
        self.known.update(zip([*plain, *(w for w, _ in mixed)], range(len(self.known), len(self.known) + len(fresh))))

    def of_words(self, words: list[str]) -> np.ndarray:
        lattice = Lattice(words, self.vocab)
        return lattice.log_totals(self.p[lattice.piece])


def predict(docs: DataFrame, langs: list[str], table: np.ndarray | None, vocab_path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the posterior of the language under equal priors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores.of(table, vocabulary(vocab_path)) if langs else None
        for batch in batches:
            found = [WORD(t) if isinstance(t, str) else [] for t in batch["text"]]
            pred, score = np.full(len(found), "und", object), np.zeros(len(found))
            if scores:
                scores.learn(found)
                n = np.fromiter(map(len, found), np.int64, len(found))
                ids = np.fromiter(map(scores.known.__getitem__, chain.from_iterable(found)), np.int64, int(n.sum()))
                some = np.flatnonzero(n)
                if len(some):
                    first = (np.cumsum(n) - n)[some]
                    like = np.add.reduceat(scores.logs[ids], first, axis=0)
                    lettered = np.add.reduceat(scores.lettered[ids].astype(np.int64), first) > 0
                    like = np.exp(like - like.max(axis=1, keepdims=True))
                    pred[some] = np.where(lettered, np.asarray(langs, object)[like.argmax(axis=1)], "und")
                    score[some] = np.where(lettered, like.max(axis=1) / like.sum(axis=1), 0.0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"].tolist(), "lang_pred": pred, "score": score})

    rows, kind = ids_as_text(docs.select("doc_id", "held_out", "text"))
    return rows.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast(kind))


def identify(docs: DataFrame, vocab_path: str | None = None) -> DataFrame:
    kept = with_columns_kept(docs, "doc_id", "text", "lang").withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1)
    langs, table = fit(kept.where(~F.col("held_out")), vocab_path)
    return predict(kept, langs, table, vocab_path)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
