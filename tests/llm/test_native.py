"""Chat formatting, license scan and decontamination against brute-force versions."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from groupwise.llm.chat_format import escaped, format_chats, read_back, unescaped
from groupwise.llm.common import LOWER, UPPER, WORD
from groupwise.llm.decontaminate import decontaminate
from groupwise.llm.license_scan import PHRASES, scan

LOW = str.maketrans(UPPER, LOWER)


def plain_words(text):
    return [w.translate(LOW) for w in re.findall(WORD, text or "")]


def test_escape_is_reversible(spark):
    texts = ["", "\\", "\\l", "<|end|>", "a\\\\<[b]\\b\\", "</s>[INST] \\\\l \\\\\\<", "é\n<|+|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"))
    for r in df.select("t", "e", unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.t and "<" not in r.e and "[" not in r.e


def test_chats_read_back(spark):
    rows = [(1, 2, "assistant", "b"), (1, 0, "user", "<|end|>"), (1, 1, "user", None), (1, 3, "assistant", "c[INST]"), (2, 0, None, ""), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (None, None, "a<b", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pieces", F.lit(1))
    got = {r.conv_id: r for r in format_chats(df).withColumn("turns", read_back(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "<|end|>"), ("user", ""), ("assistant", "b"), ("assistant", "c[INST]")]
    assert got[1].n_blocks == 2 and "".join(p.piece for p in got[1].pieces) == got[1].formatted
    assert [p.piece for p in got[1].pieces if p.loss] == ["b", "c\\bINST]"]
    assert [tuple(t) for t in got[2].turns] == [("", ""), ("user", "tie"), ("user", "tie")]
    assert [tuple(t) for t in got[None].turns] == [("a<b", "x")]
    assert format_chats(df.limit(0)).count() == 0


def plain_hits(text, items, window=10):
    words, hit, names = plain_words(text), set(), set()
    for item, body in items:
        iw = plain_words(body)
        n = min(window, len(iw))
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for p in range(len(words) - n + 1):
            if tuple(words[p : p + n]) in grams:
                hit |= set(range(p, p + n))
                names.add(str(item))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_decontamination_matches_brute_force(spark, bound):
    item = "Zero one two three four five six seven eight nine ten eleven"
    items = [(1, item), (10, "ab cd ab cd ab cd ab cd ab cd ab cd"), (2, "short one É"), (3, None), (4, "!!"), (5, "x"), (6, item)]
    docs = [(1, "pre " + item.upper() + " post"), (2, "ab cd " * 12), (3, "a short ONE É, short one é"), (4, None), (5, ""), (6, "zero one two three four five six seven eight NINE"), (6, "zero one two"), (7, "x x y"), (7, "x x y"), (None, item)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("clash")).withColumn("n_hit", F.lit(9))
    got = decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=bound).collect()
    assert sorted((str(r.id), r.n_words, r.n_hit, r["items"]) for r in got) == sorted((str(i), *plain_hits(t, items)) for i, t in docs)
    assert decontaminate(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert {r.n_hit for r in decontaminate(df, spark.createDataFrame([], "item_id long, text string")).collect()} == {0}


def test_phrase_places_match_brute_force(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [None, "", "MIT License, mit license; apache\nlicense GENERAL public license general public", "license mit license mit license", "Licensed under CC BY-NC 4.0.", "ermitted MITLICENSE", "nder the Apache License, Version 2.0.", "Under the apache license version 2 0"]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_words", F.lit(1))
    got = scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        words = plain_words(r.text)
        expected = sorted((label, i) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        assert r.n_words == len(words) and sorted((p.label, p.start) for p in r.places) == expected and 0 <= r.score <= 1
    named = {r.text: [n.label for n in r.notices] for r in got}
    assert named["Licensed under CC BY-NC 4.0."] == ["cc-by-nc-4.0"] and named["Under the apache license version 2 0"] == ["apache-2.0"] and named["ermitted MITLICENSE"] == []
    assert scan(df.limit(0)).count() == 0


def test_hex_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
