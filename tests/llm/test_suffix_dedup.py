import random

import pytest

from tessella.llm import suffix_dedup
from tessella.llm.suffix_dedup import common_prefixes, remove_repeats, suffix_array


def test_suffix_arrays_and_common_prefixes():
    random.seed(1)
    texts = [[], [5], [3, 3, 3, 3], list(range(1, 30)), list(range(30, 0, -1)), [1, 2] * 20, [2, 1] * 20, [2, 1, 2, 1, 1, 2, 1]]
    texts += [[random.randint(1, k % 6 + 1) for _ in range(random.randint(0, 60))] for k in range(600)]
    for t in texts:
        order = suffix_array(t)
        assert order == sorted(range(len(t)), key=lambda i: t[i:]), t
        for k, n in enumerate(common_prefixes(t, order)):
            a, b = t[order[k] :], t[order[k - 1] :] if k else []
            want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert n == want


def brute(docs, length):
    data = [(t or "").encode() for _, t in docs]
    seen = {}
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((d, i))
    gone = [bytearray(len(b)) for b in data]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d][i : i + length] = b"\x01" * length
    out = []
    for (doc_id, _), b, g in zip(docs, data, gone):
        spans = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        out.append((doc_id, len(b), sum(g), spans, bytes(x for x, y in zip(b, g) if not y)))
    return sorted(out, key=str)


def ran(spark, docs, length):
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, tid int")
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, length).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = lambda k: " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(k))
    passage, base = words(30), words(60)
    docs = []
    for k in range(n):
        kind = k % 5
        text = words(rng.randint(0, 60))
        if kind == 1:
            at = rng.randint(0, len(text))
            text = text[:at] + passage + text[at:]
        elif kind == 2:
            own = base.split(" ")
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = words(1)
            text = " ".join(own)
        elif kind == 3:
            a = rng.randrange(len(base))
            text = text + base[a : a + rng.randint(50, 200)]
        elif kind == 4 and docs:
            text = rng.choice(docs)[1] + ("!" if rng.random() < 0.5 else "")
        docs.append((k, text))
    return docs + [(900, None), (901, ""), (902, "ab" * 300), (903, "x" * 500), (None, passage), (3, docs[3][1]), (904, passage + passage)]


@pytest.mark.parametrize("group", [5000, 2])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    docs = corpus(group, 120)
    assert ran(spark, docs, 80) == brute(docs, 80)


def test_parts_of_long_texts_and_small_sorts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 150)
    monkeypatch.setattr(suffix_dedup, "SYMBOLS", 200)
    docs = corpus(5, 60)
    assert ran(spark, docs, 100) == brute(docs, 100)


def test_production_length_and_empty_table(spark):
    docs = corpus(6, 40) + [(1000, "y" * 399), (1001, "y" * 399), (1002, "z" * 400), (1003, "z" * 400), (1004, "q" * 401)]
    assert ran(spark, docs, 400) == brute(docs, 400)
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_what_is_removed_comes_from_the_suffix_arrays(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "sorted_groups", lambda rows, length, width: rows.limit(0).selectExpr("k1", "k2", "b", "t as low", "t as high"))
    assert all(r[2] == 0 for r in ran(spark, corpus(3, 30), 80))
