"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row

from groupwise.llm.byte_bpe import JOINTS, BytePairs, decode, encode, op13_byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pairs():
    with open(PATH, "rb") as f:
        return BytePairs(f.read(), public_tokenizers.PATTERN, JOINTS)


@pytest.fixture(scope="module")
def plain(pairs):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})


def test_every_code_point(pairs, plain):
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert pairs.encode(text).tolist() == plain.encode_ordinary(text)


def test_random_texts(pairs, plain):
    rnd = random.Random(3)
    parts = ["a", "b", "th", "ing", " ", "  ", "\n", "\t ", " ", "\x1c", " ", "é", "语", "1", "²", "'s", "'T", "'ll", "!", "...", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rnd.choice([*parts, chr(rnd.randrange(1, 0xD000)), chr(rnd.randrange(0x10000, 0x30000))]) for _ in range(rnd.randrange(60)))
        ids = pairs.encode(text)
        assert ids.tolist() == plain.encode_ordinary(text)
        assert pairs.decode(ids) == text.encode()


def test_many_texts_at_once(pairs, plain):
    rnd = random.Random(9)
    texts = ["", " "] + ["".join(rnd.choice(["re", "qu", "eau", "x", " ", " ", ",", "\n", "É", "ß", "9", "'re"]) for _ in range(rnd.randrange(400))) for _ in range(300)] + ["y" * 300 + " " + "ab" * 500]
    assert [x.tolist() for x in pairs.encode_all(texts)] == [plain.encode_ordinary(t) for t in texts]
    assert [x.tolist() for x in pairs.encode_all(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_very_long_pre_tokens(pairs, plain):
    rnd = random.Random(5)
    for text in ("a" * 60_000, "ab" * 30_000, "".join(rnd.choice("abcdeé") for _ in range(80_000)), " " * 50_000, "\n \n" * 9_000):
        assert pairs.encode(text).tolist() == plain.encode_ordinary(text)


def test_ranks_that_fall_after_a_merge():
    """Tokens made by a merge may have a lower rank than the merge itself: the queue goes back to them at once."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"bc", b"abcab", b"ca", b"cab"]
    rank_file = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    own = BytePairs(rank_file, r"[^ ]+| +", None, remembered=4)
    plain = tiktoken.Encoding("x", pat_str=r"[^ ]+| +", mergeable_ranks=own.ranks, special_tokens={})
    rnd = random.Random(7)
    for _ in range(2000):
        text = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(40)))
        assert own.encode(text).tolist() == plain.encode_ordinary(text)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 40))).encode() for _ in range(3000)]
    assert [x.tolist() for x in own.merged_all(words)] == [plain.encode_ordinary(w.decode()) if w in own.ranks else own.merged(w) for w in words]
    assert own.merged_all([]) == [] and not any(own.words) and not any(own.buckets)
    with pytest.raises(ValueError):
        BytePairs(b"", "a")


def test_rows(spark, plain):
    texts = [None, "", " ", "ab", "ab", "x" * 5000, "Ünï 'tis"]
    df = spark.createDataFrame([Row(k=i if i else None, text=t, id=9, ids="z") for i, t in enumerate(texts)], "k long, text string, id int, ids string")
    rows = encode(df, "k", "text", PATH)
    assert sorted((r.id if r.id is not None else -1, r.ids) for r in rows.collect()) == [(i or -1, plain.encode_ordinary(t or "")) for i, t in sorted(enumerate(texts), key=lambda x: x[0] or -1)]
    back = {r.id: bytes(r.decoded) for r in decode(rows, PATH).collect()}
    assert back == {(i or None): (t or "").encode() for i, t in enumerate(texts)}
    assert encode(df.where("false"), "k", "text", PATH).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [5])], "id long, ids array<int>")
    assert {r.id: bytes(r.decoded) for r in decode(nothing, PATH).collect()} == {1: b"", 2: plain.decode_bytes([5])}
    with pytest.raises(Exception, match="not in the rank file"):
        decode(spark.createDataFrame([(1, [60_000])], "id long, ids array<int>"), PATH).collect()


def test_query(spark, plain):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op13_byte_bpe(spark, sf).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        ids = plain.encode_ordinary(text)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
