import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import touchline.llm.decontamination as dc
from touchline.llm.decontamination import (CONSISTENT, SIMILAR, WIDTH, ItemBlock, Template, drop_leaks, find_leaks, op2_decontamination)

ITEMS = "item_id bigint, text string"
QUESTION = ("A train leaves the station at 60 miles per hour while Anna walks 3 miles to the market; the train travels at 60 miles per hour for 2 hours "
            "before Anna arrives.")
SWAPPED = (QUESTION.replace("60", "85").replace("Anna", "Robert").replace(" 3 ", " 7 ").replace("2 hours", "4 hours"))
MIXED = SWAPPED.replace("85 miles per hour for", "31 miles per hour for").replace("before Robert", "before Sheila")


STRIPPED = " \t\n.,;:!?\"'`()[]{}<>|“”‘’«»„…*_~#&$%@=+-/\\^€£¥、。，．！？：；（）「」"


def kinds(text):
    """(kind, word in lower case, whether a sentence starts there) of the words, by regular expressions alone."""
    out, start = [], True
    for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("([\u3040-\u30ff\u4e00-\u9fff。、！？：])", r" \1 ", text)):
        value, core = w.rstrip(".,;:!?)]\"'").lstrip("([\"'"), w.strip(STRIPPED)
        low = core.lower()
        if re.fullmatch(r"(?i)[$€£¥]?[+-]?\d+([.,:/]\d+)*(st|nd|rd|th)?(%|[a-z]{1,4})?[%€]?", value):
            kind, low = "number", value.lower()
        elif not core:
            kind = "unit" if w.strip(".,;:!?") == "%" else None
        else:
            kind = "number" if low in dc.NUMBER_WORDS else "unit" if low in dc.UNITS else "capital" if core[0].isupper() else "word"
        if kind:
            out.append((kind, low, start))
            start = False
            start = w.rstrip("\"'”’»)]")[-1:] in tuple(".!?:。！？")
    return out


def template(text, way="inside"):
    """Slots and literal words; ``way``: which capital words are names."""
    out, before = [], None
    for kind, low, start in kinds(text):
        if kind == "capital":
            kind = "name" if way == "anywhere" or (way == "inside" and not start) else "word"
        elif kind == "unit" and before != "number":
            kind = "word"
        before = {"name": "capital"}.get(kind, kind)
        token = low if kind == "word" else {"number": 1, "name": 2, "unit": 3}[kind]
        if token not in (1, 2, 3) or out[-1:] != [token]:
            out.append(token)
    return out


def brute(docs, items):
    """Pairs by comparing template windows and words as lists, without index or hashes."""
    out = set()
    needs = []
    for i, x in items:
        ways = {}
        for way in ("nowhere", "inside", "anywhere"):
            own = template(x or "", way)
            ways[way] = {w for w in (tuple(own[k:k + WIDTH]) for k in range(len(own) - WIDTH + 1)) if sum(isinstance(t, str) for t in w) >= 2}
        needs.append((i, ways, [low for _, low, _ in kinds(x or "")]))
    for d, t in docs:
        words = [low for _, low, _ in kinds(t or "")]
        for way in ("nowhere", "inside", "anywhere"):
            own = template(t or "", way)
            have = {tuple(own[k:k + WIDTH]) for k in range(len(own) - WIDTH + 1)}
            out |= {(d, i) for i, need, _ in needs if need[way] and len(need[way] & have) >= SIMILAR * len(need[way])}
        for i, need, plain in needs:
            if plain and not any(need.values()):
                n = len(plain)
                if words == plain or (n >= dc.SHORT and any(words[k:k + n] == plain for k in range(len(words) - n + 1))):
                    out.add((d, i))
    return out


def test_whole_table_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    got = op2_decontamination(spark, d).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items) and len(got) > 10
    whole = {(a, i) for a, t in docs for i, x in items if x in (t or "")}
    assert whole <= {(r.doc_id, r.item_id) for r in got}


def find(spark, docs, items):
    return find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, ITEMS)).collect()


def test_new_values_are_caught_if_they_are_consistent(spark):
    docs = [(1, f"Some words. {QUESTION} More words."), (2, f"Some words. {SWAPPED} End."), (3, MIXED), (4, "Other text about trains and markets in the town.")]
    got = {r.doc_id: r for r in find(spark, docs, [(9, QUESTION)])}
    assert set(got) == {1, 2} and got[1].n_changed == 0 and got[2].n_changed >= 5
    assert got[2].n_consistent >= CONSISTENT * got[2].n_slots
    words = docs[1][1].split()
    assert " ".join(words[got[2].first_word:got[2].last_word + 1]) == SWAPPED


def test_template_types():
    def slots(text):
        words = dc.split_words(text.encode())
        t = Template(dc.Reading(np.array([dc.read_word(w) for w in words], "u8")))
        return [(h, int(s)) for h, s in zip(t.h.tolist(), t.slot)]

    a = slots("He paid $5 for twenty five km of New York road.")
    b = slots("He paid 17.50 for 6 miles of Boston road!")
    assert a == b and [s for _, s in a] == [0, 0, 1, 0, 1, 3, 0, 2, 0]


STARTS = "Anna buys three red pens in the shop. Anna sells two of them to a friend. Anna keeps the rest for school."
SHORTS = [(1, "What is 12 * 7?"), (2, "Name four prime numbers"), (3, STARTS), (4, QUESTION), (5, "小明有三个苹果，他又买了五个，一共有几个？"), (6, "12 km, 7 miles, 9 and 3"),
          (7, "one word"), (8, "!!!"), (9, "ラーメン")]
FOUND = [("Exam. What is 12 * 7? Think.", {1}), ("What is 13 * 7?", set()), ("please name four PRIME numbers now", {2}), ("name four even numbers", set()),
         (STARTS.replace("Anna", "Robert").replace("two", "nine"), {3}), (STARTS.upper(), {3}), (STARTS.lower(), {3}), (QUESTION.lower(), {4}), (QUESTION.upper(), {4}),
         ("x" + "她说：" + SHORTS[4][1] + "请回答", {5}), ("小明有三只猫，他又卖了一只", set()), ("So 12 km, 7 MILES, 9 And 3.", {6}), ("12 km, 7 miles, 9 and 4", set()),
         ("One word", {7}), ("this is one word of many", set()), ("!!!", set()), ("私はラーメンを食べる", {9}), ("", set()), (None, set())]


def test_short_items_names_case_and_unspaced_scripts(spark):
    docs = [(i, t) for i, (t, _) in enumerate(FOUND)]
    want = {(i, k) for i, (_, ks) in enumerate(FOUND) for k in ks}
    assert {(r.doc_id, r.item_id) for r in find(spark, docs, SHORTS)} == want == brute(docs, SHORTS)
    # blocks and word ranges
    got = find(spark, docs[:1], SHORTS)[0]
    assert b" ".join(dc.split_words(docs[0][1].encode())[got.first_word:got.last_word + 1]) == b"What is 12 * 7?"


def test_quick_reading_equals_the_careful_one():
    for w in "Pens, pens. PENS! Straße: km KM, five Five. naïve? ½ a1 (Anna) Anna Ünder.. 小 ①".split():
        odd = dc.read_word(f"«{w}".encode())  # an opening mark keeps a word from the quick path
        if not any(c.isdigit() or c == "½" for c in w):
            assert odd == dc.read_word(w.encode()), w


def test_shared_phrase_makes_no_pairs(spark):
    phrase = "what is the value of the following well known expression"
    items = [(i, f"{phrase} item{i} alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i} eta{i}") for i in range(50)]
    block = ItemBlock(items)
    assert all(max(map(len, side.named.values())) == 1 for side in block.sides)
    assert find(spark, [(1, phrase * 3), (2, items[7][1])], items)[0].item_id == 7


@pytest.mark.parametrize("limit", [1, 60, 1 << 21])
def test_blocks_and_edges(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BLOCK_WINDOWS", limit)
    items = [(1, QUESTION), (1, QUESTION), (2, None), (3, "too short"), (None, "one plain item whose id is missing here now"), (4, "")]
    docs = [(1, QUESTION), (1, QUESTION), (2, None), (3, ""), (None, "One plain item whose id is missing here now"), (5, "too short"), (6, "word " * 30000 + QUESTION)]
    got = sorted(((r.doc_id, r.item_id) for r in find(spark, docs, items)), key=str)
    assert got == sorted([(1, 1), (1, 1), (5, 3), (6, 1), (None, None)], key=str)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    left = drop_leaks(frame, spark.createDataFrame(items, ITEMS))
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]
    assert find(spark, docs, []) == [] if limit > 1 else True
    assert find_leaks(frame.limit(0), spark.createDataFrame(items, ITEMS)).count() == 0
