"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans (e-mail, IP, card, phone), which always stay. The nodes of a document's field are the base spans
and all other tokens that look like such data (with an at sign, or seven digits and more). A node's label is a kind or none.
Potentials:
- unary: a multinomial logistic model over the token's shape (not over the patterns' own tests);
- chain: between neighbouring nodes, from how often neighbours share a label;
- skip: between repeated tokens (same digits or address) and similar ones (same last seven digits, same mailbox), wherever they are
  in the document, likewise learned.
Learning on the patterns' own finds alone would teach that whatever they miss is none. So each training document is seen twice: as it
is, and with each base span repeated later in a written form that the patterns miss (no plus sign, other separators, spaces around
the at sign or dots), labelled as what it is.
Base spans are clamped to their kind. Loopy sum-product message passing runs for `rounds` damped rounds; a node that is no base span
becomes a span of a kind if that kind's belief reaches `sure`. So what is clear in one place is marked in the others.

A key's nodes form a chain in order of place, so the edges grow with the nodes, however often a token repeats. Whole texts are
read; what is learned comes from about `sample_docs` documents (those with the smallest hashes of the id; a documented bound).

Null or empty text: no spans. Repeated rows are found alike. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .common import by_bytes, hash_share

#: The kinds in their order, and the patterns, in forms that scan in linear time and find the same places.
KINDS = ("email", "ip", "card", "phone")
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
BOX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens that look like personal data.
LIKELY_AT = re.compile(r"@[A-Za-z0-9][^\s@]*")
LIKELY_DIGITS = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
NONE = len(KINDS)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the patterns' matches, leftmost and not overlapping within a kind, in order."""
    found: list[Span] = []
    past = 0
    for m in AT.finditer(text):
        start = m.start()
        while start > past and text[start - 1] in BOX:
            start -= 1
        if start < m.start():
            found.append((start, 0, m.end()))
            past = m.end()
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[ -]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(found)


def shape(token: str) -> list[int]:
    """Indices of the token's shape features; none of them is a test that the patterns make."""
    digits = sum(c.isdigit() for c in token)
    return [
        0,
        1 + min(digits, 20),
        22 + ("@" in token),
        24 + token.startswith("+"),
        26 + min(token.count("."), 4),
        31 + min(token.count("-"), 3),
        35 + min(token.count(" "), 4),
        40 + ("(" in token),
        42 + any(c.isalpha() for c in token),
    ]


N_SHAPE = 44


def keys_of(token: str) -> list[str]:
    """What a token shares with its repeats and with similar tokens."""
    if "@" in token:
        low = token.lower().strip(".,;:!?\"'()<>")
        return ["a" + low, "m" + low.partition("@")[0]]
    digits = re.sub("[^0-9]", "", token)
    return ["d" + digits, "t" + digits[-7:]]


def disguised(token: str, kind: int, turn: int) -> str:
    """The token in a form that the patterns miss and a reader still knows; the form follows the turn."""
    if kind == 0:
        box, _, host = token.partition("@")
        return (f"{box}@{host.replace('.', ' ')}", f"{box}@{host.replace('.', '_')}", f"{box}@{host.partition('.')[0]}")[turn % 3]
    digits = re.sub("[^0-9]", "", token)
    if kind == 1:
        return token.replace(".", (" . ", "-", ". ")[turn % 3])
    cut = 4 if kind == 2 else 3
    groups = [digits[i : i + cut] for i in range(0, len(digits), cut)]
    return (".".join(groups), "--".join(groups), ". ".join(groups) if kind == 2 else digits)[turn % 3]


def masked(tokens: list[str], kinds: list[int], turn: int) -> tuple[list[str], list[int]]:
    """The nodes with all base spans repeated after them, disguised."""
    again = [(disguised(t, k, turn + i), k) for i, (t, k) in enumerate(zip(tokens, kinds, strict=True)) if k < NONE]
    return tokens + [t for t, _ in again], kinds + [k for _, k in again]


def nodes_of(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and the likely tokens that touch none of them, with kind NONE; in order of place."""
    base = base_spans(text)
    found, past = [], 0
    for m in LIKELY_AT.finditer(text):
        start = m.start()
        while start > past and not text[start - 1].isspace():
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
        past = m.end()
    found += [m.span() for m in LIKELY_DIGITS.finditer(text)]
    # Of tokens that touch, the one that begins first stays; base spans come before all.
    taken, other, k, past = sorted((s, e) for s, _, e in base), [], 0, 0
    for start, end in sorted(found):
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if start >= past and (k == len(taken) or taken[k][0] >= end):
            other.append((start, NONE, end))
            past = end
    return base, sorted(base + other)


def edges_of(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes and their sort: 0 neighbours, 1 same, 2 similar."""
    pairs = {(i, i + 1): 0 for i in range(len(tokens) - 1)}
    last: dict[str, int] = {}
    for i, t in enumerate(tokens):
        for sort, key in zip((1, 2), keys_of(t), strict=True):
            if key in last and (pairs.get((last[key], i), 0) == 0):
                pairs[last[key], i] = sort
            last[key] = i
    return np.array(list(pairs), np.int64).reshape(-1, 2), np.array(list(pairs.values()), np.int64)


@dataclass
class Field:
    unary: np.ndarray  # (N_SHAPE, labels) log weights
    pair: np.ndarray  # (3, labels, labels) potentials by sort of edge

    def beliefs(self, tokens: list[str], clamp: np.ndarray, rounds: int = 10, damp: float = 0.5) -> np.ndarray:
        """Sum-product over all edges at once; clamp: a node's label, or -1."""
        n, labels = len(tokens), self.unary.shape[1]
        logit = np.array([self.unary[shape(t)].sum(axis=0) for t in tokens]).reshape(n, labels)
        own = np.exp(logit - logit.max(axis=1, keepdims=True))
        own /= own.sum(axis=1, keepdims=True)
        own[clamp >= 0] = np.eye(labels)[clamp[clamp >= 0]]
        pairs, sort = edges_of(tokens)
        if not len(pairs):
            return own
        src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        pot = np.concatenate([self.pair[sort], self.pair[sort].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        message = np.full((len(src), labels), 1 / labels)
        for _ in range(rounds):
            total = np.log(own + 1e-12)
            np.add.at(total, dst, np.log(message + 1e-12))
            out = total[src] - np.log(message[back] + 1e-12)
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.einsum("el,elm->em", out, pot)
            new /= new.sum(axis=1, keepdims=True)
            message = damp * message + (1 - damp) * new
        total = np.log(own + 1e-12)
        np.add.at(total, dst, np.log(message + 1e-12))
        belief = np.exp(total - total.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)

    def spans(self, text: str, sure: float = 0.9) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans. Only documents with an unclamped node need the field."""
        base, nodes = nodes_of(text)
        if len(base) == len(nodes):
            return base, base
        clamp = np.array([k if k < NONE else -1 for _, k, _ in nodes])
        belief = self.beliefs([text[s:e] for s, _, e in nodes], clamp)
        more = [(s, int(b[:NONE].argmax()), e) for (s, k, e), b in zip(nodes, belief, strict=True) if k == NONE and b[:NONE].max() >= sure]
        return base, sorted(base + more)


def learn(docs: DataFrame, sample_docs: int = 4000, steps: int = 200) -> Field:
    """docs: (id, text). Labels: base spans, their disguised repeats, and the other nodes as none; piecewise: unary by logistic regression, pairs by counts."""
    labels = NONE + 1

    def seen_in(tokens: list[str], kinds: list[int]) -> list[tuple]:
        pairs, sort = edges_of(tokens)
        rows = [(0, k, " ".join(map(str, shape(t)))) for t, k in zip(tokens, kinds, strict=True)]
        return rows + [(1 + int(s), kinds[a] * labels + kinds[b], "") for (a, b), s in zip(pairs, sort, strict=True)]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                rows = []
                for text in part["text"].to_pylist():
                    _, nodes = nodes_of(text or "")
                    tokens, kinds = [text[s:e] for s, _, e in nodes], [k for _, k, _ in nodes]
                    rows += seen_in(tokens, kinds)
                    if min(kinds, default=NONE) < NONE:
                        rows += seen_in(*masked(tokens, kinds, len(text)))
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["what", "value", "shape"])

    got = hash_share(docs, ["id", "text"], sample_docs).mapInArrow(sample, "what int, value int, shape string").groupBy("what", "value", "shape").agg(F.count("*").alias("n")).orderBy("what", "value", "shape").collect()
    unary, pair = np.zeros((N_SHAPE, labels)), np.ones((3, labels, labels)) + 4 * np.eye(labels)
    seen = [r for r in got if r.what == 0]
    for r in got:
        if r.what:
            a, b = divmod(r.value, labels)
            pair[r.what - 1, a, b] += r.n
            pair[r.what - 1, b, a] += r.n
    if seen:
        x = np.zeros((len(seen), N_SHAPE))
        for i, r in enumerate(seen):
            x[i, list(map(int, r["shape"].split()))] = 1
        y, w = np.eye(labels)[[r.value for r in seen]], np.array([r.n for r in seen], float)
        w /= w.sum()
        for _ in range(steps):  # gradient ascent with a small ridge; the table of shapes is tiny
            p = np.exp(x @ unary - (x @ unary).max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            unary += 1.0 * (x.T @ (w[:, None] * (y - p)) - 1e-4 * unary)
    own = pair.sum(axis=2, keepdims=True) * pair.sum(axis=1, keepdims=True) / pair.sum(axis=(1, 2), keepdims=True)
    return Field(unary, pair / own)


SPAN = ArrayType(StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 4000, sure: float = 0.9) -> DataFrame:
    """docs with base and all spans: arrays of (kind, start, end), code points, by start and then kind. Columns of these names are replaced."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    field = learn(rows, sample_docs)
    kept = docs.drop("base_spans", "all_spans")
    names = kept.columns
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rows_of = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, text_col):
                found = [field.spans(t or "", sure) for t in part[text_col].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), pa.array([rows_of(b) for b, _ in found], kind), pa.array([rows_of(a) for _, a in found], kind)], names=[*names, "base_spans", "all_spans"])

    return kept.mapInArrow(run, StructType(list(kept.schema)).add("base_spans", SPAN).add("all_spans", SPAN))


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first one's kind stands for their union."""
    fields = [f for f in found.schema if f.name not in ("base_spans", "all_spans")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, text_col):
                texts = []
                for text, spans in zip(part[text_col].to_pylist(), part["all_spans"].to_pylist(), strict=True):
                    out, past = [], 0
                    for s in spans or []:
                        if s["start"] >= past:
                            out += [text[past : s["start"]], f"<{s['kind']}>"]
                        past = max(past, s["end"])
                    texts.append(text if text is None else "".join([*out, text[past:]]))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else part[c] for c in names], names=names)

    return found.mapInArrow(run, StructType(fields))


def op4_pii_skip_chain(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("all_spans").alias("spans"))
