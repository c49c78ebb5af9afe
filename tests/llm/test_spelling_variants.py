"""Spelling variants against plain versions over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from groupwise.llm.common import LOWER, UPPER
from groupwise.llm.spelling_variants import near_words, op11_spelling_variants, pivots, spelling_variants, vocabulary


def plain_vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain_variants(words, neighbours):
    out = {}
    for w, n in words.items():
        near = neighbours(w)
        form = min(near, key=lambda x: (-words[x], x)) if near else None
        out[w] = (n, len(near), form if form and words[form] >= 5 * n else None)
    def root(w):
        return root(out[w][2]) if out[w][2] else w
    return {w: (n, k, form, words[form] if form else None, root(w)) for w, (n, k, form) in out.items()}


def result(df):
    rows = [(r.word, (r.n, r.n_near, r.form, r.form_n, r.root)) for r in df.collect()]
    assert len(rows) == len({w for w, _ in rows})
    return dict(rows)


@pytest.mark.parametrize("seed", range(4))
def test_random_words(spark, seed):
    """Few letters, so that words repeat bigrams and have many neighbours; chains of forms; counts that tie."""
    rnd = random.Random(seed)
    letters = ("ab", "abc", "abcdé÷", "abcdefghijklm")[seed]
    words = {}
    for _ in range(250):
        w = "".join(rnd.choice(letters) for _ in range(rnd.randrange(4, 12)))
        for _ in range(4):
            words[w] = rnd.choice([5, 6, 25, 30, 150, 700, 4000])
            i = rnd.randrange(len(w) + 1)
            w = rnd.choice([w[:i] + rnd.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i + 1 :]])
            if len(w) < 4:
                break
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert result(spelling_variants(df)) == plain_variants(words, near.__getitem__)
    assert {(r.word, r.near) for r in near_words(df).collect()} == {(w, x) for w in words for x in near[w]}


def test_pivots_are_the_cheapest_disjoint_ones():
    rnd = random.Random(2)
    order = {a + b: (k, rnd.randrange(1, 50)) for k, (a, b) in enumerate((a, b) for a in "abc" for b in "abc")}
    for _ in range(500):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randrange(4, 14)))
        last, left, right, places = pivots(w, order)
        grams = [order[w[i : i + 2]] for i in range(len(w) - 1)]
        assert last == sorted(r for r, _ in grams)[2] and places == [i for i, (r, _) in enumerate(grams) if r <= last]
        assert grams[left][1] + grams[right][1] == min(grams[i][1] + grams[j][1] for i in places for j in places if j >= i + 2)
        assert right >= left + 2


def test_long_word_and_common_end(spark):
    """A very long word, and a thousand words that share all but their ends."""
    long = "qx" * 3000
    words = {long: 9, long + "a": 60, long[:-1]: 5} | {"zzzzqq" + a + b: 7 for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = result(spelling_variants(df))
    assert got[long] == (9, 2, long + "a", 60, long + "a") and got[long[:-1]] == (5, 1, None, None, long[:-1])
    assert all(got["zzzzqq" + x][:2] == (7, 50) for x in ("ab", "zz", "mq"))


def test_defined_cases(spark):
    rows = [(1, None), (None, "Colour colour COLOUR colour colour"), (2, ""), (3, "x" * 5000), (3, "colours " * 40), (3, "colours " * 40), (4, "ÀÉcolor × ÷ab")]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    assert {r.word: r.n for r in vocabulary(df, "doc_id", "text").collect()} == plain_vocabulary(rows)
    none = df.where("false")
    assert spelling_variants(vocabulary(none, "doc_id", "text")).count() == 0
    with pytest.raises(Exception, match="disjoint"):
        near_words(spark.createDataFrame([("abc", 5)], "word string, n long")).collect()


def test_query(spark):
    """The whole query at sf0.001 against all single edits, looked up."""
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = plain_vocabulary(rows)
    letters = sorted({c for w in words for c in w})

    def neighbours(w):
        ends = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        edits = {a + c + b[k:] for a, b in ends for k in (0, 1) if len(b) >= k for c in [*letters, ""]}
        return [x for x in edits if x != w and x in words]

    assert result(op11_spelling_variants(spark, sf)) == plain_variants(words, neighbours)
