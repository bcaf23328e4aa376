import random

import numpy as np

from tessella.llm import lm_score
from tessella.llm.lm_score import CLUSTERS, PAD, SIDE, VOCABULARY, Network, hashed, padded, score, score_documents, slots, train


def test_probabilities_sum_to_one():
    net = Network(seed=3)
    around = np.random.default_rng(1).integers(0, VOCABULARY + 1, (2, 2 * SIDE)).astype(np.int16)
    for row in around:
        p = [np.exp(net.log_probabilities(np.concatenate([row[:SIDE], [k], row[SIDE:]]).astype(np.int16))[0]) for k in range(VOCABULARY)]
        assert abs(sum(p) - 1) < 1e-3
    for name in ("cluster", "member"):  # scores whose exponentials would overflow
        net.w[name] *= 100
    assert not net.moderate() and np.isfinite(net.log_probabilities(np.arange(50, dtype=np.int16))).all()


def test_gradients_against_differences():
    rng = np.random.default_rng(2)
    sequence, weight = rng.integers(0, 40, 22 + 2 * SIDE).astype(np.int16), rng.integers(0, 4, 22).astype(np.float32)
    sequence[10] = PAD
    net = Network(seed=1)
    before = Network(net.flat())
    net.learn(sequence, weight)
    mean = lambda n: -(n.log_probabilities(sequence) * weight).sum() / weight.sum()
    for name in ("hidden", "cluster_bias", "place", "member", "embedding"):
        moved = net.w[name] - before.w[name]
        at = np.unravel_index(np.abs(moved).argmax(), moved.shape)
        loss = []
        for eps in (5e-2, -5e-2):
            other = Network(before.flat())
            other.w[name][at] += eps
            loss.append(mean(other))
        assert np.sign(moved[at]) == -np.sign(loss[0] - loss[1]), name
        gradient = np.sqrt(net.squares[name][at] - 1e-4) * -np.sign(moved[at])  # what Adagrad noted of its first step
        assert abs((loss[0] - loss[1]) / 1e-1 - gradient) < 0.05 * abs(gradient) + 2e-4, name
    assert mean(net) < mean(before)


def test_surroundings():
    """A token's probability depends on SIDE tokens to either side, and not on the token itself or any further off."""
    net = Network(seed=4)
    one, starts = padded([np.arange(1, 12, dtype=np.int16), np.arange(20, 23, dtype=np.int16)])
    assert one.tolist() == [PAD] * 3 + list(range(1, 12)) + [PAD] * 3 + [20, 21, 22] + [PAD] * 3 and starts.tolist() == [3, 17]
    base = net.log_probabilities(one)[5]
    for k, other in ((0, False), (1, False), (2, True), (4, True), (6, True), (8, True), (9, False)):
        changed = one.copy()
        changed[SIDE + k] = 77
        assert (abs(net.log_probabilities(changed)[5] - base) > 1e-6) == other, k
    assert CLUSTERS**2 == VOCABULARY and net.log_probabilities(one)[11] == 0


def test_learns_word_order_and_scores_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH", 64)
    random.seed(8)
    sentences = ["the river runs to the sea", "a stone falls into the river", "we walk along the sea at night", "the night falls on the land"]
    docs = [(k, " ".join(random.choice(sentences) for _ in range(30))) for k in range(80)]
    words = " ".join(sentences).split()
    docs += [(1000, " ".join(random.choice(words) for _ in range(200))), (2000, None), (2001, ""), (2002, " \n"), (None, docs[0][1]), (0, docs[0][1]), (3000, "the river " * 20_000)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n_tokens int").repartition(4)
    out = {}
    for r in score_documents(df).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, out.values())) == len(docs)
    ordered = np.mean([out[k][0].mean_log_likelihood for k in range(80)])
    assert out[1000][0].mean_log_likelihood < ordered - 0.5 and ordered > -3
    assert [(out[k][0].n_tokens, out[k][0].log_likelihood, out[k][0].mean_log_likelihood) for k in (2000, 2001, 2002)] == [(0, 0.0, None)] * 3
    assert out[0][0].log_likelihood == out[0][1].log_likelihood and abs(out[None][0].log_likelihood - out[0][0].log_likelihood) < 1e-3
    assert out[3000][0].n_tokens == 40_000


def test_scores_against_plain_sum(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "STEP", 7)
    monkeypatch.setattr(lm_score, "LEAST_SHARE", 0.05)
    texts = ["one two three four five six seven eight nine ten eleven", "x", "a b " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = train(df, 1)
    net = Network(model.weights)
    words = [w for t in texts for w in t.split()]
    slot = {w: int(slots(hashed([w])[0])[0]) for w in words}
    for r in score(df, model).collect():
        own = texts[r.doc_id].split()
        want = net.log_probabilities(padded([slots(hashed([texts[r.doc_id]])[0])])[0]).sum()
        for w in own:
            of_slot = [x for x in words if slot[x] == slot[w]]
            rare = {x for x in of_slot if words.count(x) < 0.05 * len(words)}
            n = sum(x in rare for x in of_slot) / len(rare) if w in rare else words.count(w)
            want += np.log(n / len(of_slot))
        assert abs(r.log_likelihood - want) < 1e-2
    empty = df.limit(0)
    assert score_documents(empty).count() == 0


def test_scores_do_not_depend_on_the_split(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD", 500)
    monkeypatch.setattr(lm_score, "PART", 90)
    monkeypatch.setattr(lm_score, "FAN_IN", 2)
    monkeypatch.setattr(lm_score, "BATCH", 64)
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 200)))) for k in range(60)] + [(100 + k, "the same text " * 20) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one = {r.doc_id: r.log_likelihood for r in score_documents(df.coalesce(1)).collect()}
    other = {r.doc_id: r.log_likelihood for r in score_documents(df.repartition(8)).collect()}
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-3 for k in one)


def test_equal_words_have_equal_hashes_wherever_they_are(monkeypatch):
    monkeypatch.setattr(lm_score, "CHARS", 16)
    rng = random.Random(6)
    spaces = [" ", "\n", "\t ", "\x1c", "\x85", "\u2003", "\u3000 "]
    words = ["".join(rng.choice("abAB\u0130Σé漢\U0001f600\ud800\x00\u200b") for _ in range(rng.randint(1, 7))) for _ in range(400)] + ["x" * 100, "ab" * 50]
    texts = [None, "", " \n", "a", " a b"] + ["".join(rng.choice(words) + rng.choice(spaces) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["".join(words)]
    hashes, starts = hashed(texts)
    plain = [t.lower().split() if t else [] for t in texts]
    assert np.diff(starts).tolist() == [len(x) for x in plain] and len(hashes) == starts[-1]
    by_word = {}
    for w, h in zip([w for x in plain for w in x], hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    counts = np.bincount(slots(hashed([f"word{k}" for k in range(400_000)])[0]), minlength=VOCABULARY)
    assert len(counts) == VOCABULARY and 40 < counts.min() and counts.max() < 160  # as by chance: 98 a slot
    monkeypatch.setattr(lm_score, "CHARS", 32_768)
    assert (hashed(texts)[0] == hashes).all() and len(hashed([])[0]) == 0 and hashed([])[1].tolist() == [0]


def test_probabilities_do_not_depend_on_what_is_beside_them():
    """So that repeated rows score alike in whatever batches they are."""
    net, rng = Network(seed=5), np.random.default_rng(9)
    sequence, _ = padded([rng.integers(0, VOCABULARY, 3000).astype(np.int16)])
    whole = net.log_probabilities(sequence)
    for size in (1, 7, 50, 111, 640, 1000):
        parts = [net.log_probabilities(sequence[low : low + size + 2 * SIDE]) for low in range(0, 3000, size)]
        assert (np.concatenate(parts) == whole).all(), size
