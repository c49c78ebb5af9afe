"""Byte-level BPE: encoding and decoding by a rank file, as the tiktoken library would do it without special tokens.

A text is cut by a pattern into pre-tokens. A pre-token that is itself a token is that token. Any other begins as a linked list of its
bytes; again and again the neighbours whose joined bytes have the lowest rank become one node, the leftmost such pair first, until
no pair has a rank. The pairs wait in a rank queue: one bucket of list positions per rank, and a bitmap of the buckets in use, with
bitmaps above it of the words in use below. Finding the lowest rank is one find-first-set a level (three for 50,256 ranks), whatever
the length of the pre-token. Merges leave entries behind that no longer hold; they are known by the rank that the node's pair has now and
skipped. A pre-token of n bytes costs n pushes, at most n merges with two pushes each, and a heap step inside a bucket: n log n. Short
pre-tokens share one queue, whose buckets then hold positions of very many of them, and are merged in rounds of NumPy operations.

Rows are independent: no shuffle, no state between rows but a table of already encoded short pre-tokens, emptied when it is full.

Null and empty texts have no ids; ids of null decode to no bytes. Repeated rows and null ids of rows are kept as they are. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

#: Letters and numbers that Unicode has taken in after version 16, first and last of each run. The splitter to agree with takes them for neither; the regex module knows them.
LATER = (
    "0558-0558 058B-058C 088F-088F 0C5C-0C5C 0CDC-0CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 A7F1-A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DE0-11DE9 11DF1-11DF1 1246F-1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 "
    "187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: A code point of private use, which is no letter, number or white space.
NEITHER = ""
#: Places where no match of public_tokenizers.PATTERN can go on: a space between two characters that are no white space begins a new one.
JOINTS = r"(?<=\S)(?= \S)"


#: Bytes of text whose new pre-tokens are merged together; one longer text is a slice of its own.
SLICE = 1 << 24


class BytePairs:
    """The tokens of a rank file (lines of a base64 token and its rank) and the pattern that cuts texts.

    joints: where a text may be cut before the pattern is matched, or None; it must fit the pattern. What lies between two joints (at most
    `longest` characters) is remembered: about the last `remembered` of them, and as many before those.
    """

    def __init__(self, rank_file: bytes, pattern: str, joints: str | None = None, remembered: int = 1 << 18, longest: int = 40):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"{len(missing)} bytes have no token")
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.pattern, self.joints = regex.compile(pattern), re.compile(joints) if joints else None
        self.later = regex.compile("[" + "".join(f"\\U{int(a, 16):08X}-\\U{int(b, 16):08X}" for a, b in (run.split("-") for run in LATER.split())) + "]")
        self.recent: dict[str, array] = {}
        self.earlier: dict[str, array] = {}
        self.remembered, self.longest = remembered, longest
        # The rank queue, empty between pre-tokens: positions by rank, and the lower level of the bitmap; the upper level is one integer.
        self.shift = max(1, math.isqrt(size - 1).bit_length())
        self.buckets: list[list[int] | None] = [None] * size
        self.words = [0] * ((size >> self.shift) + 1)
        self.after, self.before = list(range(1, 257)), list(range(-1, 255))  # the links of short lists
        self.bits = [1 << k for k in range(1 << self.shift)]
        # All ways to join two tokens to a third, for many lookups at once.
        self.factor = size
        ways = sorted((self.ranks[t[:k]] * size + self.ranks[t[k:]], rank) for t, rank in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks)
        self.joined = np.array([*(key for key, _ in ways), 1 << 62], np.int64)
        self.joined_rank = np.array([*(rank for _, rank in ways), -1], np.int64)
        self.byte_pairs = [[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]

    def cut(self, text: str) -> list[str]:
        if text.isascii() or not self.later.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.later.sub(NEITHER, text))]

    def merged(self, piece: bytes) -> list[int]:
        """The tokens of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        tokens, find, buckets, words, shift, bits, n = self.tokens, self.ranks.get, self.buckets, self.words, self.shift, self.bits, len(piece)
        low = len(bits) - 1
        node = list(map(self.bytes.__getitem__, piece))
        after, before = (self.after[:n], self.before[:n]) if n <= len(self.after) else (list(range(1, n + 1)), list(range(-1, n - 1)))
        # The rank of each node joined with its right neighbour; -1: none, or the node is gone.
        pair = [row[b] for row, b in zip(map(self.byte_pairs.__getitem__, piece), piece[1:])]
        pair.append(-1)
        top = 0  # bit w: words[w] is not 0; bit k of words[w]: the bucket of rank w * 2^shift + k is in use
        for i, rank in enumerate(pair):
            if rank >= 0:
                bucket = buckets[rank]
                if bucket:
                    bucket.append(i)  # i only grows here, so this is a heap
                else:
                    buckets[rank] = [i]
                    words[rank >> shift] |= bits[rank & low]
                    top |= bits[rank >> shift]
        while top:
            w = (top & -top).bit_length() - 1  # find first set, at both levels
            word = words[w]
            bit = word & -word
            rank = (w << shift) + bit.bit_length() - 1
            bucket, token, lowest = buckets[rank], tokens[rank], rank
            while bucket and lowest >= rank:  # a pair that a merge makes may be of a lower rank, and is next then
                i = heappop(bucket)
                if pair[i] != rank:
                    continue  # stale
                gone = after[i]
                right, left = after[gone], before[i]
                node[i], after[i], pair[gone], pair[i] = rank, right, -1, -1
                if right < n:
                    before[right] = i
                    pair[i] = new = find(token + tokens[node[right]], -1)
                    if new >= 0:
                        other = buckets[new]
                        if other:
                            heappush(other, i)
                        else:
                            buckets[new] = [i]
                            words[new >> shift] |= bits[new & low]
                            top |= bits[new >> shift]
                        if new < lowest:
                            lowest = new
                if left >= 0:
                    pair[left] = new = find(tokens[node[left]] + token, -1)
                    if new >= 0:
                        other = buckets[new]
                        if other:
                            heappush(other, left)
                        else:
                            buckets[new] = [left]
                            words[new >> shift] |= bits[new & low]
                            top |= bits[new >> shift]
                        if new < lowest:
                            lowest = new
            if not bucket:
                buckets[rank] = None
                words[w] ^= bit
                if not words[w]:
                    top ^= bits[w]
        out, i = [], 0
        while i < n:
            out.append(node[i])
            i = after[i]
        return out

    def merged_all(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The tokens of each pre-token: the same queue over all of them at once. A round takes the lowest rank in use and, of each pre-token that
        has it, the leftmost position; pre-tokens do not touch, so each goes through the very merges that it would alone."""
        size, count = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.concatenate([[0], np.cumsum(count)])
        n = int(starts[-1])
        if not n:
            return [np.zeros(0, np.int32)] * size
        node = np.append(np.array(self.bytes, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)], -1)  # node n stands for none
        owner = np.repeat(np.arange(size), count)
        after, before, alive = np.arange(1, n + 2), np.arange(-1, n), np.ones(n + 1, bool)
        after[starts[1:] - 1], before[starts[:-1]] = n, n
        pair = self.rank_of(node, node[after[: n + 1].clip(max=n)])
        pair[n] = -1
        buckets, words, shift, bits, top = self.buckets, self.words, self.shift, self.bits, 0
        low = len(bits) - 1

        def push(ranks: np.ndarray, places: np.ndarray, top: int) -> int:
            there = ranks >= 0
            ranks, places = ranks[there], places[there]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, some in zip(ranks[np.append(0, cuts)].tolist() if len(ranks) else (), np.split(places, cuts), strict=False):
                if buckets[rank]:
                    buckets[rank].append(some)
                else:
                    buckets[rank] = [some]
                    words[rank >> shift] |= bits[rank & low]
                    top |= bits[rank >> shift]
            return top

        top = push(pair[:n], np.arange(n), top)
        while top:
            w = (top & -top).bit_length() - 1  # find first set, at both levels
            bit = words[w] & -words[w]
            rank = (w << shift) + bit.bit_length() - 1
            some = buckets[rank]
            at = some[0] if len(some) == 1 else np.concatenate(some)
            at = at[pair[at] == rank]  # the others are stale
            later = at[:0]
            if len(at) > 1:
                at = np.unique(at)
                whose = owner[at]
                leftmost = np.append(True, whose[1:] != whose[:-1])
                at, later = at[leftmost], at[~leftmost]
            if len(later):
                buckets[rank] = [later]
            else:
                buckets[rank] = None
                words[w] ^= bit
                if not words[w]:
                    top ^= bits[w]
            if not len(at):
                continue
            gone, left = after[at], before[at]
            right = after[gone]
            node[at], after[at], before[right], pair[gone], alive[gone] = rank, right, at, -1, False
            pair[at] = behind = self.rank_of(rank, node[right])
            pair[left] = ahead = self.rank_of(node[left], rank)
            pair[n] = -1
            top = push(np.concatenate([behind, ahead]), np.concatenate([at, left]), top)
        alive = alive[:n]
        return np.split(node[:n][alive].astype(np.int32), np.cumsum(np.bincount(owner[alive], minlength=size))[:-1])

    def rank_of(self, left: np.ndarray | int, right: np.ndarray) -> np.ndarray:
        """The rank of two tokens joined, -1 if there is none or either is -1."""
        key = left * self.factor + right
        at = np.searchsorted(self.joined, key)
        return np.where((self.joined[at] == key) & (right >= 0), self.joined_rank[at], -1)

    def learn(self, texts: list[str]) -> None:
        """Remember the ids of all parts of the texts that are short and not yet known."""
        fresh: dict[str, list[bytes]] = {}
        for text in texts:
            for part in self.parts(text):
                if part not in fresh and part not in self.recent and part not in self.earlier and len(part) <= self.longest:
                    fresh[part] = [p.encode() for p in self.cut(part)]
        unknown = [p for p in dict.fromkeys(p for cut in fresh.values() for p in cut) if p not in self.ranks]
        found = dict(zip(unknown, self.merged_all(unknown), strict=True))
        if len(self.recent) >= self.remembered:
            self.earlier, self.recent = self.recent, {}
        for part, cut in fresh.items():
            ids = array("i")
            for p in cut:
                rank = self.ranks.get(p)
                if rank is None:
                    ids.frombytes(found[p].tobytes())
                else:
                    ids.append(rank)
            self.recent[part] = ids

    def parts(self, text: str) -> list[str]:
        return self.joints.split(text) if self.joints else self.cut(text)

    def encode(self, text: str) -> array:
        out = array("i")
        recent, earlier = self.recent, self.earlier
        for part in self.parts(text):
            ids = recent.get(part)
            if ids is None:
                ids = earlier.get(part)
                if ids is None:
                    for piece in self.cut(part):
                        out.extend(self.merged(piece.encode()))
                    continue
                if len(recent) < 2 * self.remembered:
                    recent[part] = ids
            out += ids
        return out

    def encode_all(self, texts: list[str]) -> list[array]:
        """As encode, for many texts: what is short and new is merged together first; long pre-tokens are merged one by one."""
        self.learn(texts)
        return list(map(self.encode, texts))

    def decode(self, ids: array | list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Vocabulary:
    """A rank file for the workers: the driver reads it (under a MB) and broadcasts it, so executors need no such path; a worker parses it once."""

    def __init__(self, df: DataFrame, path: str, pattern: str):
        with open(path, "rb") as f:
            content = f.read()
        self.pattern, self.digest, self.content = pattern, hashlib.sha256(content).hexdigest(), df.sparkSession.sparkContext.broadcast(content)

    def pairs(self) -> BytePairs:
        key = (self.digest, self.pattern)
        if key not in _parsed:
            _parsed.clear()
            _parsed[key] = BytePairs(self.content.value, self.pattern, JOINTS if self.pattern == public_tokenizers.PATTERN else None)
        return _parsed[key]


#: The vocabulary that this worker has parsed, kept between its tasks.
_parsed: dict[tuple[str, str], BytePairs] = {}


def _in_lists(values: list[array]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*(np.frombuffer(x, np.int32) for x in values), np.zeros(0, np.int32)])))


def encode(texts: DataFrame, id_col: str, text_col: str, path: str, pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """(id, ids): the token ids of every whole text, in order. With `decoded` also the bytes that the ids give back, decoded where they are encoded."""
    vocabulary = Vocabulary(texts, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = vocabulary.pairs()
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                values = pairs.encode_all([t or "" for t in part["text"].to_pylist()])
                back = [pa.array(list(map(pairs.decode, values)), pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([part["id"], _in_lists(values), *back], names=["id", "ids", *["decoded"] * decoded])

    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the bytes of every list of ids; an id that the file does not have is an error."""
    vocabulary = Vocabulary(encoded, path, public_tokenizers.PATTERN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = vocabulary.pairs()
        for batch in batches:
            found = []
            for ids in batch["ids"]:
                listed = ids.as_py() or []
                if listed and not 0 <= min(listed) <= max(listed) < len(pairs.tokens):
                    raise ValueError("an id is not in the rank file")
                found.append(pairs.decode(listed))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found, pa.binary())], names=["id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, decoded binary")


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", path, decoded=True)
    ids = F.array_join("ids", ",").cast("binary")
    return both.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
