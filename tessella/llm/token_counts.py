"""Token counts at every prefix of a text, by prefix dynamic programming.

A byte-pair encoding of a prefix is fixed by the prefix before its last token and that token: of the
vocabulary's tokens that end at a byte, exactly one goes with the last token of what stands before it.
So one pass over a word gives the number of tokens of each of its prefixes, and a running sum over
the words of a text gives it for each prefix of the text.  Budgets and cuts are then lookups.

Null text counts as empty.  An empty text has 0 tokens.  Repeated rows give repeated rows; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import ids_as_text, read_table, with_columns_kept

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
#: Words whose prefix counts a worker keeps; on reaching it the memory is emptied, results don't change.
WORD_CACHE = 400_000
#: Bytes up to which a word's beginnings are kept for other words.
SHARED = 24


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


@lru_cache(maxsize=2)
def encoding(path: str | None = None) -> tiktoken.Encoding:
    """The byte-level BPE whose special string inside a text is the special token, as the library's default has it."""
    import public_tokenizers as P

    return tiktoken.Encoding("byte_bpe", pat_str=P.PATTERN, mergeable_ranks=ranks_of(path or P.path("byte_bpe_50k.tiktoken")), special_tokens={SPECIAL: SPECIAL_ID})


def token_ids(enc: tiktoken.Encoding, text: str) -> list[int]:
    """A text's ids; runs of white space that are too long for the encoding's own splitter are split by `regex`."""
    try:
        return enc.encode(text, allowed_special="all")
    except ValueError:
        words_of, out = splitter(), []
        for k, part in enumerate(text.split(SPECIAL)):
            out += [SPECIAL_ID] * (k > 0)
            for word in words_of(part):
                out += enc._encode_single_piece(word.encode())
        return out


@lru_cache(maxsize=1)
def splitter() -> Callable[[str], list[str]]:
    import public_tokenizers as P

    return regex.compile(P.PATTERN).findall


class PrefixCounter:
    """Exact token counts for every prefix (in characters) of texts."""

    def __init__(self, path: str | None = None) -> None:
        self.encoding = encoding(path)
        self.ranks = self.encoding._mergeable_ranks
        self.token = {v: k for k, v in self.ranks.items()}
        ends: dict[bytes, set[int]] = {}
        short = sorted({len(t) for t in self.ranks if len(t) < 3}, reverse=True)
        for t in self.ranks:
            if len(t) > 2:
                ends.setdefault(t[-3:], set()).add(len(t))
        #: By the last three bytes of some text: the sizes of the tokens that it may end with, the longest first.
        self.sizes = {end: (*sorted(own, reverse=True), *short) for end, own in ends.items()}
        self.short = tuple(short)
        self.words_of = splitter()
        self.spaces = regex.compile(r"\s{2,}")
        self.steps: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[bytes, tuple[int, int]] = {}

    def goes_with(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes together is a, then b."""
        if (found := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self.encoding._encode_single_piece(self.token[a] + self.token[b]) == [a, b]
        return found

    def byte_counts(self, word: bytes) -> list[int]:
        """Tokens of word[:i] for i = 0 .. len(word), by the recurrence count[i] = count[i - len(last)] + 1."""
        n, ranks, states, sizes, short, goes = len(word), self.ranks, self.states, self.sizes.get, self.short, self.pairs
        last, count = [-1] * (n + 1), [0] * (n + 1)
        if len(states) > 3 * WORD_CACHE:
            states.clear()
        for i in range(1, n + 1):
            state = states.get(word[:i]) if i < SHARED else None  # words share beginnings
            if state is None:
                for size in sizes(word[i - 3 : i], short) if i > 2 else range(i, 0, -1):
                    j = i - size
                    t = ranks.get(word[j:i]) if j >= 0 else None
                    if t is not None and (j == 0 or goes.get((last[j], t)) or self.goes_with(last[j], t)):
                        state = t, count[j] + 1
                        break
                if i < SHARED:
                    states[word[:i]] = state
            last[i], count[i] = state
        return count

    def word_steps(self, word: str) -> bytes:
        """Differences of the counts of a word's prefixes, a signed byte a character."""
        if (found := self.steps.get(word)) is not None:
            return found
        if len(self.steps) >= WORD_CACHE:
            self.steps.clear()
        if word[0] == "'" and len(word) > 2:  # a contraction: its proper prefixes fall into two words
            counts = [sum(self.byte_counts(w.encode())[-1] for w in self.words_of(word[:i])) for i in range(len(word) + 1)]
        else:
            raw = self.byte_counts(word.encode())
            if len(raw) == len(word) + 1:
                counts = raw
            else:
                counts, at = [0], 0
                for c in word:
                    at += len(c.encode())
                    counts.append(raw[at])
        steps = struct.pack(f"{len(word)}b", *map(sub, counts[1:], counts))
        if len(word) < 64:
            self.steps[word] = steps
        return steps

    def plain_table(self, text: str) -> np.ndarray:
        cached, fresh = self.steps.get, self.word_steps
        parts = [cached(w) or fresh(w) for w in self.words_of(text)]
        base = np.zeros(len(text) + 1, np.int32)
        np.cumsum(np.frombuffer(b"".join(parts), np.int8), dtype=np.int32, out=base[1:])
        table = base.copy() if "  " in text or "\n" in text or self.spaces.search(text) else base
        for m in self.spaces.finditer(text):  # a prefix that ends in a run of white space has the run as one word
            run, s = m.group(), m.start()
            table[s + 1 : s + len(run) + 1] = base[s] + np.cumsum(np.frombuffer(self.word_steps(run), np.int8), dtype=np.int32)
        if len(text) and text[-1:].isspace():
            return table
        table[-1] = base[-1]
        return table

    def table(self, text: str | None) -> np.ndarray:
        """counts[i] = tokens of text[:i], for i = 0 .. len(text)."""
        text = text or ""
        if SPECIAL not in text:
            return self.plain_table(text)
        out, done = [np.zeros(1, np.int32)], 0
        pieces = text.split(SPECIAL)
        for k, piece in enumerate(pieces):
            own = self.plain_table(piece)
            out.append(own[1:] + done)
            if k + 1 < len(pieces):
                # Only the last two words can change with what follows.
                tail = "".join(self.words_of(piece)[-2:])
                before = int(own[-1]) - int(self.plain_table(tail)[-1])
                cut = [before + self.plain_table(tail + SPECIAL[:i])[-1] for i in range(1, len(SPECIAL))]
                out.append(np.asarray([*cut, own[-1] + 1], np.int32) + done)
                done += int(own[-1]) + 1
        return np.concatenate(out)


@lru_cache(maxsize=2)
def counter_of(path: str | None = None) -> PrefixCounter:
    """One for each worker process, whose known words serve its later tasks."""
    return PrefixCounter(path)


def tokens_in(table: np.ndarray, chars: int) -> int:
    """Tokens of the prefix of that many characters."""
    return int(table[min(max(chars, 0), len(table) - 1)])


def fits(table: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most `budget` tokens (prefix counts need not grow with each character)."""
    return int(np.flatnonzero(table <= budget)[-1]) if budget >= 0 else 0


def count_tokens(docs: DataFrame, limit: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: the longest prefix within the limit, from the prefix table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = counter_of(tokenizer)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text if isinstance(text, str) else ""
                table = counter.table(text)
                n = int(table[-1])
                rows.append((len(text.encode()), n, n > limit, fits(table, limit) if n > limit else len(text)))
            yield pd.DataFrame({"doc_id": batch["doc_id"]}).assign(**dict(zip(("n_bytes", "n_tokens", "over_limit", "fit_chars"), zip(*rows) if rows else ([],) * 4)))

    kept, kind = ids_as_text(with_columns_kept(docs, "doc_id", "text"))
    out = kept.mapInPandas(run, "doc_id string, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
