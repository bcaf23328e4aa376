import random
import zlib
from functools import lru_cache

import numpy as np

from tessella.llm.language_id import UNKNOWN, Lattice, identify, vocabulary


def brute_total(word, p):
    """Sum over all segmentations, by recursion."""
    vocab = vocabulary()
    ids = {s: k for k, s in enumerate(vocab.pieces)}
    word = "▁" + word

    @lru_cache(None)
    def rest(at):
        if at == len(word):
            return 1.0
        out = 0.0
        for end in range(at + 1, len(word) + 1):
            k = ids.get(word[at:end])
            if k is not None:
                out += p[k] * rest(end)
            elif end == at + 1:
                out += UNKNOWN * rest(end)
        return out

    return rest(0)


def test_forward_and_backward_sum_all_segmentations():
    vocab, rng = vocabulary(), np.random.default_rng(1)
    p = rng.random(vocab.size) / 1000
    words = ["the", "river", "漢字x", "a", "unbelievableness", "é", "zzzzqqqq", "x" * 40]
    lattice = Lattice(words, vocab)
    edge = np.append(p, UNKNOWN)[lattice.piece]
    alpha, beta = lattice.forward(edge), lattice.backward(edge)
    want = [brute_total(w, p) for w in words]
    assert np.allclose(lattice.totals(alpha), want, rtol=1e-9) and np.allclose(beta[lattice.base], want, rtol=1e-9)
    posterior = alpha[lattice.source] * edge * beta[lattice.target] / np.asarray(want)[lattice.word_of]
    covered = np.bincount(lattice.word_of, weights=posterior * (lattice.target - lattice.source))
    assert np.allclose(covered, [len(w) + 1 for w in words])  # each character lies in one piece of each segmentation


def test_held_out_accuracy_and_edge_cases(spark):
    random.seed(2)
    stems = {"en": ["the", "ing", "and", "riv", "er"], "fr": ["eau", "oui", "les", "ment", "que"], "de": ["sch", "ung", "der", "keit", "ich"]}
    docs = [(k, " ".join("".join(random.choice(stems[lang]) for _ in range(2)) for _ in range(20)), lang) for k in range(240) for lang in [random.choice(list(stems))]]
    docs += [(1000, None, "en"), (1001, "", "fr"), (1002, "123 --- 456", "de"), (None, "the and ing", "en"), (1003, "eau oui " * 30_000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as held_out")
    out = {r.doc_id: r for r in identify(df).collect()}
    assert len(out) == len(docs)
    for doc_id, text, lang in docs[:240]:
        assert out[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
        assert 0 <= out[doc_id].score <= 1
    held = [(out[d].lang_pred, lang) for d, _, lang in docs[:240] if out[d].held_out]
    assert sum(a == b for a, b in held) >= 0.98 * len(held) > 30
    assert [(out[k].lang_pred, out[k].score) for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert out[1003].lang_pred == "fr" and out[None].lang_pred == "en"


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "the river", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identify(df).collect()] == [("und", 0.0)]
    assert identify(df.limit(0)).count() == 0


def log_brute(word, p, longest):
    """The log of the sum over all segmentations, place by place."""
    vocab = vocabulary()
    ids = {s: k for k, s in enumerate(vocab.pieces)}
    word = "▁" + word
    logs = [0.0]
    for end in range(1, len(word) + 1):
        own = [logs[at] + np.log(p[ids[word[at:end]]]) for at in range(max(0, end - longest), end) if word[at:end] in ids]
        if word[end - 1] not in ids:
            own.append(logs[end - 1] + np.log(UNKNOWN))
        logs.append(np.logaddexp.reduce(own))
    return logs[-1]


def test_words_of_any_length_and_rare_pieces_do_not_underflow():
    vocab, rng = vocabulary(), np.random.default_rng(3)
    words = ["the", "q" * 40, "unbelievable" * 30, "漢" * 200, "x" * 47, "y" * 48, "z" * 49, "riversandstones" * 7]
    for p in (rng.random(vocab.size) / 1000, np.full(vocab.size, 3e-9)):
        lattice = Lattice(words, vocab)
        edge = np.append(p, UNKNOWN)[lattice.piece]
        want = [log_brute(w, p, vocab.longest) for w in words]
        assert np.allclose(lattice.log_totals(edge), want, rtol=1e-9)
        covered = np.bincount(lattice.word_of, weights=lattice.posteriors(edge) * lattice.size)
        assert np.allclose(covered, [len(w) + 1 for w in words])


def test_numerals_are_no_letters_and_long_words_are_whole(spark):
    docs = [(k, "the river and the stone", "en") for k in range(6)] + [(k, "le pont est la", "fr") for k in range(6, 12)]
    docs += [(100, "½ ² Ⅷ ③", "en"), (101, "the² ½ and", None), (102, "theriverand" * 50_000, None), (103, "½", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in identify(df).collect()}
    assert [(out[k].lang_pred, out[k].score) for k in (100, 103)] == [("und", 0.0)] * 2
    assert out[101].lang_pred == "en" and out[102].lang_pred == "en" and out[102].score == 1.0
