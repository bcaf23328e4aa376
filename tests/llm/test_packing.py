import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tessella.llm import packing


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, docs, capacity):
    """Every piece holds its document's ids, sequences are gapless and within the capacity, whole pieces follow the first."""
    lib, by_doc, by_seq = library(), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in docs:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert k == 0 or r.length == capacity
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_whole_pieces_and_few_sequences(spark):
    random.seed(3)
    docs = [(k, " ".join(random.choice(["the", "river", "stone", "é", "<|endoftext|>", "12"]) for _ in range(random.randint(0, 150)))) for k in range(150)]
    docs += [(500, None), (501, ""), (502, "word " * 700)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), capacity=128).collect()
    n = check(rows, docs, 128)
    bound = -(-sum(r.length for r in rows) // 128)
    assert n <= bound * 1.02 + 1


def test_several_demes_and_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "DEME", 60)
    random.seed(5)
    docs = [(k, "a " * random.randint(0, 90)) for k in range(400)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), capacity=100).collect()
    n = check(rows, docs, 100)
    assert n <= -(-sum(r.length for r in rows) // 100) * 1.03 + 2


def test_repeated_rows_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x y", "p", 9)] * 3, "doc_id long, text string, piece string, pid int")
    rows = packing.pack(df).collect()
    assert len(rows) == 3 and len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows) == [0, 3, 6]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.doc_id for r in packing.pack(spark.createDataFrame([(None, "x")], "doc_id long, text string")).collect()] == [None]


@pytest.mark.parametrize("n", [1, 99, 100, 101, 200, 250])
def test_cut_points(n):
    cuts = packing.cut_points(n, 100)
    assert sum(length for _, length in cuts) == n and all(length == 100 for _, length in cuts[1:])


def test_moves_keep_every_piece_once():
    deme = packing.Deme(np.random.default_rng(1).integers(1, 100, 300), 100, 7)
    a, b = deme.fresh(), deme.fresh(0.5)
    for moved in (deme.crossed(a, b), deme.mutated(a), deme.evolved([a, b], 5)):
        assert (moved >= 0).all() and deme.fills(moved).max() <= 100 and (deme.fills(moved) > 0).all()
    assert deme.fitness(deme.evolved([a, b], 5)) <= deme.fitness(a)


def test_crossover_beats_best_fit():
    """Three pieces that fill a sequence exactly: best fit of descending lengths starts with pairs that leave gaps."""
    rng = np.random.default_rng(11)
    lengths = []
    for _ in range(60):
        a, b = sorted(rng.integers(250, 500, 2).tolist())
        lengths += [a, b, 1000 - a - b]
    deme = packing.Deme(np.asarray(lengths), 1000, 3)
    plain = deme.fresh()
    best = deme.evolved([], 40)
    assert deme.fitness(best)[0] < deme.fitness(plain)[0]
    assert deme.bound <= deme.fitness(best)[0]


def test_very_long_texts(spark):
    docs = [(1, "river " * 200_000), (2, " " * 700_000), (3, "q" * 300_000)]
    check(packing.pack(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs, 2048)
