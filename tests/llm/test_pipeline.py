import random

import corpus_pipeline
from tessella.llm import decontamination


def prose(rng, n):
    stems = ["ri", "ver", "sto", "ne", "la", "ke", "mo", "un", "tain", "bel", "gro"]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    item = prose(rng, 40)
    page = "\n".join(prose(rng, 15) for _ in range(6))
    long = prose(rng, 300).split()
    near = " ".join([*long[:-1], "changed"])
    docs = [(k, "\n".join(prose(rng, 25) for _ in range(3)), "en", "s") for k in range(60)]
    docs += [
        (100, "too short", "en", "s"),
        (101, page, "en", "s"),
        (102, prose(rng, 30) + "\n" + page, "en", "s"),
        (103, page, "en", "s"),
        (104, " ".join(long), "en", "s"),
        (105, near, None, "s"),
        (106, prose(rng, 20) + " " + item + " " + prose(rng, 20), "en", "s"),
        (107, None, None, None),
        (108, "", "en", "s"),
        (None, prose(rng, 50), "en", "s"),
    ]
    table = spark.createDataFrame([(*d, len(d[1] or ""), "extra") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, row string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == table.columns, name
        d = spark.createDataFrame(d.collect(), table.schema)
        seen.append({r.doc_id: r for r in d.collect()})
    rules, lines, groups, clean = seen
    everyone = {x[0] for x in docs}
    assert everyone - set(rules) == {100, 107, 108}
    assert set(rules) - set(lines) == {103}
    assert lines[102].text == docs[62][1].split("\n")[0] and lines[102].n_chars == len(lines[102].text)
    assert lines[101].text == page
    assert set(lines) - set(groups) == {105}
    assert set(groups) - set(clean) == {106}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(clean)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][-1] == "best-fit packing"
    assert decontamination.WINDOW == 5


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_clashing_names(spark, tmp_path):
    rng = random.Random(5)
    texts = [prose(rng, 30) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (3, prose(rng, 24)), (None, texts[5]), (None, prose(rng, 25)), (None, "")]
    names = ["text_hash", "th", "row", "group", "rejected_key", "gone_row_key", "leaked", "doc", "kept", "cuts", "uid", "key", "verdict_key", "pid"]
    table = spark.createDataFrame([(d, t, "en", "s", len(t), *range(len(names))) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    spark.createDataFrame([(1, texts[7])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, sizes = table, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = spark.createDataFrame(stage(spark, d, str(tmp_path)).collect(), table.schema)
        assert d.columns == table.columns, name
        sizes.append(sorted((-1 if r.doc_id is None else r.doc_id, len(r.text.split())) for r in d.collect()))
    assert sizes[0] == sorted([*((k, 30) for k in range(12)), (3, 30), (3, 24), (-1, 30), (-1, 25)])
    assert sizes[2] == sorted([*((k, 30) for k in range(12)), (3, 24), (-1, 25)])
    assert sizes[3] == [x for x in sizes[2] if x != (7, 30)]
    assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() == len(sizes[3])
