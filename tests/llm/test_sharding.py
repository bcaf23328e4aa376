import random

from tessella.llm.sharding import assign


def shards(spark, rows, limit):
    out = assign(spark.createDataFrame(rows, "doc_id long, text string, bits string"), limit).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard_id, []).append(r)
    for own in by.values():
        assert sum(r.n_bytes for r in own) == own[0].shard_bytes and len(own) == own[0].shard_docs
        assert own[0].shard_bytes <= limit or len(own) == 1
    return by


def brute(rows, limit):
    import hashlib

    bits = {d: format(int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16), "060b") for d, *_ in rows}
    out = {}

    def split(own, depth):
        if sum(len(t.encode()) for _, t, _ in own) <= limit or len(own) == 1:
            for d, *_ in own:
                out[d] = f"{depth}:{bits[d][:depth]}"
            return
        for bit in "01":
            if part := [r for r in own if bits[r[0]][depth] == bit]:
                split(part, depth + 1)

    split(rows, 0)
    return out


def test_only_oversized_buckets_split(spark):
    random.seed(1)
    rows = [(k, "x" * random.randint(0, 60), "") for k in range(400)] + [(1000, "y" * 900, "")]
    by = shards(spark, rows, 500)
    assert {r.doc_id: r.shard_id for own in by.values() for r in own} == brute(rows, 500)


def test_one_key_with_most_rows(spark):
    by = shards(spark, [(7, "x" * 50, "")] * 300 + [(None, "z" * 10, "")] * 40 + [(8, None, ""), (9, "", "")], 400)
    assert len(by) >= 300 * 50 // 400


def test_empty(spark):
    assert assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    from tessella.llm.sharding import write_shards

    docs = spark.createDataFrame([(k % 3, "x" * 40, k) for k in range(60)], "doc_id long, text string, bits int")
    write_shards(docs, str(tmp_path / "out"), 200)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.bits for r in back.collect()) == list(range(60)) and back.select("shard_id").distinct().count() >= 12
