import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm.token_counts import cache, op9_token_counts, prefix_tables, prefix_tokens, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "don't'll I'S", "x<|endoftext|>y <|ENDOFTEXT|>", "İstanbul ǅ ﬁ x́é 안녕 ΣΑΣ", "a　b\x85c\x1cd",
       "word., next.. !end 12ab3", "word " * 3000, "z" * 5000, "tie", "tie"]


def library(text):
    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(make_docs):
    got = {r.doc_id: r for r in token_counts(make_docs(list(enumerate(ODD))), PATH, 100).collect()}
    assert {i: library(t) for i, t in enumerate(ODD)} == {i: r.n_tokens for i, r in got.items()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        assert got[i].n_bytes == len(raw)
        cut = raw[:got[i].cut_bytes].decode()
        assert library(cut) <= 100
        if len(cut) < len(t or ""):
            rest = (t or "")[len(cut):]
            assert all(library(cut + rest[:k]) > 100 for k in range(1, 4))


def test_whole_table_equals_the_library(spark):
    d = "/root/testdata/sf0.001"
    tok = Tokenizer.from_file(PATH)
    want = {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids)
            for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in op9_token_counts(spark, d).collect()}
    assert got == {k: (v, v > 2048) for k, v in want.items()}


def test_prefix_programme_equals_encoding_each_prefix():
    random.seed(3)
    c = cache(PATH, "count")
    for _ in range(200):
        w = "".join(random.choice("etaoinshr.,1'é") for _ in range(random.randint(1, 16)))
        assert prefix_tokens(c, PATH, w) == [len(c.encode(w[:k])) for k in range(len(w) + 1)], w


def test_empty_table_and_clashing_columns(make_docs):
    docs = make_docs([(1, "one two")]).withColumn("n_tokens", F.lit("x"))
    assert token_counts(docs.limit(0), PATH).count() == 0
    assert token_counts(docs, PATH).collect()[0].n_tokens == library("one two")


@pytest.mark.parametrize("rows", [[(1, "same"), (1, "same")]])
def test_repeated_rows_stay(make_docs, rows):
    assert token_counts(make_docs(rows), PATH).count() == 2


@pytest.mark.parametrize("letters", ["日本語のテキストは空白がない。", "e\u0301a\u0308'sxか\u3099は\u309a", "한ᄒ\u1161\u11abあ\u3000\u0085ß", "'re'stİΣσ1٣x", "<|endoftext|> é<|x",
                                     "ก็นี่คือข้อความ", "\u0301\u0327q\u0327\u0301-'"])
def test_prefixes_of_words_in_all_scripts_equal_encoding_each(letters):
    rnd = random.Random(5)
    c = cache(PATH, "count")
    for n in (1, 2, 3, 5, 8, 13, 40):
        for _ in range(30):
            w = "".join(rnd.choice(letters) for _ in range(n)).replace(" ", "")
            assert prefix_tokens(c, PATH, w) == [len(c.encode(w[:k])) for k in range(len(w) + 1)], w
    for w in ("a<|endoftext|>b<|startoftext|>é<|endoftext|", "<|endoftext|><|endoftext|>", letters.replace(" ", "")):
        assert prefix_tokens(c, PATH, w) == [len(c.encode(w[:k])) for k in range(len(w) + 1)], w


def test_count_at_every_prefix_equals_the_library():
    text = "One two, don't  stop. Ünïcödé 日本語のテキスト\n\tx<|endoftext|>y e\u0301nd "
    (_, p), = prefix_tables([(1, text.encode())], PATH)
    for k in range(len(text) + 1):
        assert p.count_at(len(text[:k].encode())) == library(text[:k]), k
    assert p.count_at(len("One two, don't  stop. ") + 1) == library("One two, don't  stop. ")  # inside the two bytes of a letter


def test_long_unspaced_text_takes_linear_time():
    text = "".join(random.Random(6).choice("日本語文字列長空白無漢") for _ in range(100_000))
    began = time.time()
    (_, p), = prefix_tables([(1, text.encode())], PATH)
    cut = p.cut(2048)
    assert library(text[:cut // 3]) <= 2048 < library(text[:cut // 3 + 4]) and cut % 3 == 0
    assert time.time() - began < 60
