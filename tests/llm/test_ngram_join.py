import random
import re

import numpy as np
import pytest

from tessella.llm import ngram_join
from tessella.llm.ngram_join import join


def sets_of(texts, n):
    out = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(docs, n, percent):
    sets, parent = sets_of([t for _, t in docs], n), list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if root(j) == root(i) and docs[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def ran(spark, docs, n=3, percent=90):
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, n long")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in join(df, n, percent).collect()), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 90)))) for k in range(n)]
    base = [rng.choice(vocab) for _ in range(150)]
    docs += [(1000 + k, edited(rng, base, rng.randint(0, 5))) for k in range(n)]
    for k in range(n):  # chains: each a little further from the last
        base = edited(rng, base, 1).split()
        docs.append((2000 + k, " ".join(base)))
    return docs + [(5000, None), (5001, ""), (5002, " \n"), (5003, "One two"), (5004, "one  TWO"), (5005, "one"), (None, "one two"), (5003, "One two"), (None, "lone words of a null id"), (5006, "a b c"), (5007, "a\x1cb c")]


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_against_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    docs = corpus(rounds, 40)
    assert ran(spark, docs) == brute(docs, 3, 90)


def test_other_parameters_and_shuffled_ids(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_BITS", 4096)
    monkeypatch.setattr(ngram_join, "TILE", 3)
    docs = corpus(11, 25)
    assert ran(spark, docs, 5, 80) == brute(docs, 5, 80)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    assert ran(spark, [(2, long), (1, long + " more")]) == [(1, 59_999, 1), (2, 59_998, 1)]
    assert join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_bands_and_parts_lose_no_link(percent):
    bands = ngram_join.Bands(percent)
    rng = np.random.default_rng(percent)
    for n in range(1, 400):
        assert bands.edges[bands.of(n)] <= n < bands.edges[bands.of(n) + 1]
        assert bands.of(100 * n // percent) - bands.of(n) in (0, 1)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        out = int(rng.integers(0, max(1, n // 8) + 1))
        y = np.unique(np.concatenate([x[out:], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 8) + 1)), dtype=np.uint64)]))
        common = len(np.intersect1d(x, y))
        if len(y) and 100 * common >= percent * (len(x) + len(y) - common):
            assert np.intersect1d(ngram_join.tile_keys(x, bands), ngram_join.tile_keys(y, bands)).size
