import random

from tessella.llm.line_dedup import dedup_lines


def brute(docs, min_lines):
    """Marks every visible line covered by a window of min_lines lines that occurred before."""
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, k))
    seen, out = set(), {}
    for k in order:
        text = docs[k][1]
        if text is None:
            out[k] = (None, 0, 0, 0)
            continue
        lines = text.split("\n")
        shown = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for p in range(len(shown) - min_lines + 1):
            window = tuple(lines[i] for i in shown[p : p + min_lines])
            if window in seen:
                gone |= set(range(p, p + min_lines))
            seen.add(window)
        runs = sum(1 for p in gone if p - 1 not in gone)
        deleted = {shown[p] for p in gone}
        out[k] = ("\n".join(x for i, x in enumerate(lines) if i not in deleted), len(lines), len(gone), runs)
    return out


def run(spark, docs, min_lines):
    rows = [(d, t, k) for k, (d, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long").coalesce(1)
    return {r.doc.row: (r.kept, r.n_lines, r.n_removed, r.n_runs) for r in dedup_lines(df, min_lines).collect()}


def test_against_brute_force(spark):
    random.seed(6)
    docs = [(k, "\n".join(random.choice(["a", "b", "c", "", "d", " "]) for _ in range(random.randint(0, 14)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "a"), (104, "a"), (3, docs[3][1]), (105, "x\n" * 300), (106, "x\n" * 200 + "y\n" * 5)]
    for min_lines in (2, 4):
        assert run(spark, docs, min_lines) == brute(docs, min_lines)


def test_least_lengths_between_powers_of_two(spark):
    random.seed(8)
    docs = [(k, "\n".join(random.choice(["a", "b", "c", ""]) for _ in range(random.randint(0, 14)))) for k in range(30)]
    docs += [(100, "p\nq\nr\nx"), (101, "p\nq\nr\ny"), (102, "z\np\nq\nr"), (103, "1\n2\n3\n4\n5\n6"), (104, "1\n2\n3\n4\n5\n7")]
    for min_lines in (3, 5):
        assert run(spark, docs, min_lines) == brute(docs, min_lines)


def test_long_copies_hot_lines_and_repeated_rows(spark):
    random.seed(7)
    body = [f"line {k}" for k in range(70)]
    docs = [(k, "\n".join(["menu", *body[k % 5 : 40 + k % 7], f"own {k}", "menu"])) for k in range(30)] + [(7, "p\nq\nr")] * 3
    assert run(spark, docs, 2) == brute(docs, 2)


def test_empty_and_missing_columns(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert dedup_lines(spark.createDataFrame([(None, None)], "doc_id long, text string")).first().kept is None


def test_one_long_line(spark):
    long = "a passage " * 40
    docs = [(1, f"one\n{long}\ntwo"), (2, f"three\n{long}\nfour\nfive"), (3, long), (4, "short\nx"), (5, "short\ny"), (6, f"four\nfive\n{long}\nfour\nfive")]
    got = run(spark, docs, 2)
    assert [got[k] for k in range(6)] == [(docs[0][1], 3, 0, 0), ("three\nfour\nfive", 4, 1, 1), ("", 1, 1, 1), ("short\nx", 2, 0, 0), ("short\ny", 2, 0, 0), ("", 5, 5, 1)]
