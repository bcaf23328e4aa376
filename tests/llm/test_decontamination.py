import random

import pytest

from tessella.llm import decontamination
from tessella.llm.decontamination import clean, leaks

ITEM = "A train leaves Paris at 9:30 with 120 passengers and travels 250 km to Lyon. How many passengers does the train carry when Maria boards in Lyon with 3 friends?"


def tables(spark, docs, items):
    return spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ri", "ver", "sto", "ne", "la", "ke", "mo"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


DOCS = [
    (1, f"{prose(40, 1)}. {ITEM} {prose(50, 2)}"),
    (2, ITEM.replace("Paris", "Rome").replace("Lyon", "Milan").replace("Maria", "Anna").replace("120", "88").replace("250", "310").replace("km", "miles")),
    (3, ITEM.replace("to Lyon", "to Milan")),  # the same name stands for two
    (4, prose(300, 3)),
    (5, None),
    (6, ""),
    (7, f"{prose(2000, 4)}. {ITEM}"),
    (8, " ".join(ITEM.split()[:12])),  # half of it
    (None, ITEM),
    (9, f"{ITEM} {ITEM}"),
]


@pytest.mark.parametrize("sent", [10**6, 0])
def test_leaks_word_for_word_and_with_other_values(spark, monkeypatch, sent):
    monkeypatch.setattr(decontamination, "SENT_WINDOWS", sent)
    docs, items = tables(spark, DOCS + [(1, DOCS[0][1])], [(10, ITEM), (11, prose(60, 8)), (12, None), (13, "")])
    found = sorted(((r.doc_id, r.item_id) for r in leaks(docs, items).collect()), key=str)
    assert found == sorted([(1, 10), (2, 10), (7, 10), (9, 10), (None, 10)], key=str)
    assert sorted(r.doc_id for r in clean(docs, items).collect()) == [3, 4, 5, 6, 8]
    assert docs.columns == clean(docs, items).columns


def test_every_alignment_is_checked(spark):
    other = ITEM.replace("to Lyon", "to Milan")  # the same template, filled inconsistently
    docs, items = tables(spark, [(1, f"{other} {prose(40, 1)}. {ITEM}"), (2, f"{ITEM} {prose(40, 2)}. {other}"), (3, f"{other} {prose(40, 3)}. {other}"), (4, f"{other} {other} {other} {ITEM}")], [(10, ITEM)])
    assert sorted(r.doc_id for r in leaks(docs, items).collect()) == [1, 2, 4]


def test_slots_beyond_an_insertion_are_compared_where_they_were_met(spark):
    item = "A farmer sorts 5 crates of apples into rows before the market opens and then writes the labels 3 5 7 9 on them for the buyers to read"
    docs = [(1, item.replace("labels 3", "labels neatly 3")), (2, item.replace("labels 3", "labels neatly 3").replace("5", "8").replace("9", "2")), (3, item.replace("sorts 5", "sorts 6").replace("labels 3", "labels neatly 3"))]
    docs, items = tables(spark, docs, [(10, item)])
    assert sorted(r.doc_id for r in leaks(docs, items).collect()) == [1, 2]  # in the third 5 stands for two


def test_short_items_and_empty_tables(spark):
    docs, items = tables(spark, [(1, "so what is love anyway"), (2, "love is what")], [(5, "what is love")])
    assert [(r.doc_id, r.item_id) for r in leaks(docs, items).collect()] == [(1, 5)]
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0
    assert clean(docs, items.limit(0)).count() == 2


def test_against_brute_force(spark):
    rng = random.Random(5)
    items = [(k, prose(rng.randint(8, 30), 100 + k)) for k in range(12)]
    docs = []
    for k in range(60):
        words = prose(rng.randint(0, 80), 1000 + k).split()
        if k % 2:
            own = rng.choice(items)[1].split()
            if k % 4 == 3:
                own[rng.randrange(len(own))] = "changedword"
            at = rng.randint(0, len(words))
            words[at:at] = own
        docs.append((k, " ".join(words)))
    windows = lambda t: [tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))]
    want = set()
    for d, text in docs:
        have = set(windows(text))
        for i, item in items:
            own = windows(item)
            if sum(w in have for w in own) >= 0.8 * len(own):
                want.add((d, i))
    a, b = tables(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in leaks(a, b).collect()} == want and len(want) > 15


def test_runs_of_one_symbol_and_repeated_item_ids(spark):
    rng = random.Random(9)
    numbers = lambda n: " ".join(str(rng.randint(1, 10**6)) for _ in range(n))
    item = numbers(60)
    docs = [(k, f"{prose(10, k)} {numbers(3000)}") for k in range(5)] + [(7, f"{numbers(500)} {item} {numbers(500)}"), (8, prose(100_000, 3) + " " + ITEM)]
    a, b = tables(spark, docs, [(1, item), (1, ITEM), (2, prose(20, 77)), (None, ITEM)])
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks(a, b).collect()}
    assert {k for k in got if k[0] in (7, 8)} == {(7, 1), (8, 1), (8, None)} and got[7, 1] == 1.0


def test_conflicting_slots_in_a_copy_that_is_nearly_word_for_word(spark):
    long = f"{prose(80, 6)} {ITEM}"
    docs = [(1, long.replace("to Lyon", "to Milan")), (2, ITEM.replace("to Lyon", "to Milan"))]
    a, b = tables(spark, docs, [(10, long), (11, ITEM)])
    assert [(r.doc_id, r.item_id) for r in leaks(a, b).collect()] == [(1, 10)]


def test_a_clean_text_with_the_id_of_a_leak_stays(spark):
    docs, items = tables(spark, [(1, ITEM), (1, prose(50, 2)), (None, prose(30, 3)), (None, ITEM)], [(10, ITEM)])
    left = clean(docs.withColumnRenamed("item_id", "gone_row_key"), items).collect()
    assert sorted(len(r.text.split()) for r in left) == [30, 50]
