import random

import public_tokenizers
from tokenizers import Tokenizer

from tessella.llm.token_counts import PrefixCounter, count_tokens, encoding, fits, token_ids, tokens_in


def test_every_prefix_counts_as_the_library_has_it():
    lib, counter = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), PrefixCounter()
    random.seed(2)
    parts = [*"ab'lrets  \n\t 12é漢🙂 .<|endoftext|>", "<|endoftext|>", "'ll", "'re", " the", " ", "\r\n"]
    for _ in range(300):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 25)))
        table = counter.table(text)
        assert [int(x) for x in table] == [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)], text


def test_budgets():
    table = PrefixCounter().table("the river the stone")
    assert tokens_in(table, 0) == 0 and tokens_in(table, 10**6) == table[-1]
    assert fits(table, 2) == len("the river") and fits(table, 0) == 0


def test_rows(spark):
    docs = spark.createDataFrame([(1, "the river", 5), (2, None, 5), (3, "", 5), (None, "é", 5), (1, "the river", 5), (4, "word " * 60_000, 5)], "doc_id long, text string, n_tokens int")
    rows = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs).collect()), key=str)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert rows == sorted([(1, 9, 2, False), (1, 9, 2, False), (2, 0, 0, False), (3, 0, 0, False), (4, 300_000, len(lib.encode("word " * 60_000).ids), True), (None, 2, 1, False)], key=str)
    assert count_tokens(docs.limit(0)).count() == 0


def test_a_million_of_one_character():
    lib, counter = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), PrefixCounter()
    random.seed(4)
    for text in (" " * 1_000_000, "q" * 1_000_000, "".join(random.choice("abcdefgh") for _ in range(1_000_000)), "x" + " " * 1_000_000 + "y<|endoftext|> a", "\n" * 500_000 + "é" * 200_000):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert token_ids(encoding(), text) == ids and counter.table(text)[-1] == len(ids)
