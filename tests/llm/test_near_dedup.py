"""Near-duplicate groups against a brute-force version."""

import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from groupwise.llm.common import LOWER, UPPER, split_words
from groupwise.llm.near_dedup import components, links, near_duplicates, simhash_texts
import pyarrow as pa


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBÉ \t\n.x", max_size=60)), max_size=8))
def test_fingerprints_follow_the_definition(texts):
    assert simhash_texts(pa.array(texts, pa.string()), 3).tolist() == [plain_fingerprint(t) for t in texts]


def test_only_ascii_case_and_space_count():
    every = "".join(chr(c) for c in range(0x800) if not 0xD800 <= c < 0xE000) + "\U0001F600\u212a"
    texts = ["before"] * 3 + [every, " ".join(every), None, "  a\x0bB\x85c\xa0D "]
    texts, sliced = texts[2:], pa.array(texts)[2:]
    starts, words = split_words(sliced)
    plain = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans(UPPER, LOWER))) for t in texts]
    assert [words.to_pylist()[a:b] for a, b in zip(starts, starts[1:])] == plain


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('the cat sat')").first()[0] % 2**64 == xxhash.xxh64_intdigest("the cat sat", 42)


def test_groups_match_brute_force(spark):
    base = [f"w{i % 7} w{i * 3 % 11} Word{i} " * 12 for i in range(12)]
    texts = base + [t + "more" for t in base[:6]] + [None, "", "  ", "one", "ONE", "one two"] + base[:3]
    rows = [(i + 1, t, "clash") for i, t in enumerate(texts)]
    prints = {i: plain_fingerprint(t) for i, t, _ in rows}
    expected = plain_groups(prints)
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    for dense in (64, 1):  # 1: every shared cell takes the way for crowded cells
        got = near_duplicates(docs, dense=dense).collect()
        assert {r.id: (r.fp % 2**64, r.component) for r in got} == {i: (prints[i], expected[i]) for i in prints}


def test_links_at_exact_distances(spark):
    rows = [(1, 0), (2, 3), (3, 7), (4, -(1 << 63)), (5, (1 << 62) - 1), (6, 0b1111000)]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    for dense, bits in ((64, 2), (1, 1), (1, 2)):
        if True:
            found = components(links(nodes, max_bits=bits, dense=dense)).collect()
            roots = {i: i for i, _ in rows} | {r.node: r.root for r in found}
            flat = {i: f % 2**64 for i, f in rows}
            groups = {i: i for i in flat}
            for _ in rows:
                for i in flat:
                    for j in flat:
                        if (flat[i] ^ flat[j]).bit_count() <= bits:
                            groups[i] = groups[j] = min(groups[i], groups[j])
            assert roots == groups


def test_long_chain_and_empty_table(spark):
    chain = spark.range(12).selectExpr("id + 1 as src", "id as dst")
    assert {r.root for r in components(chain).collect()} == {0}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
