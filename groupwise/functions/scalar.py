"""Column functions: identities, classes, bins, lists, similarity, timestamps. No Python runs per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR_ID = r"^D-?(\d+)_A-?(\d+)$"


def is_pair_id(s: Column) -> Column:
    """Whether normalize_id accepts s; null is rejected."""
    return F.coalesce(F.trim(s).rlike(PAIR_ID), F.lit(False))


def normalize_id(s: Column) -> Column:
    """`D-007_A12` and the like become `D7_A12`; null where s is no pair id."""
    number = lambda k: F.regexp_extract(F.trim(s), PAIR_ID, k).cast("long").cast("string")
    return F.when(is_pair_id(s), F.concat(F.lit("D"), number(1), F.lit("_A"), number(2)))


def id_sort_key(s: Column) -> Column:
    """Pair ids in numeric order."""
    return F.struct(F.regexp_extract(s, PAIR_ID, 1).cast("long").alias("first"), F.regexp_extract(s, PAIR_ID, 2).cast("long").alias("second"))


def group_id(s: Column) -> Column:
    """SHA-256 hex of a canonical string."""
    return F.sha2(s, 256)


def pair_id(first: Column, second: Column) -> Column:
    """Of an ordered pair."""
    return F.sha2(F.concat(first, F.lit(">>"), second), 256)


def role_aware_id(s: Column, first: Column, second: Column) -> Column:
    """Of a string in its roles."""
    return F.sha2(F.concat(s, F.lit("||D:"), first, F.lit("||A:"), second), 256)


def canonical_text(s: Column) -> Column:
    """Case, punctuation and white space folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[\p{P}\p{S}]+", " "), r"\s+", " "))


def role_class(first: Column, second: Column, unknown: Column) -> Column:
    """Counts of the two roles and of unknown parts."""
    return F.when((first == 0) | (second == 0), "empty").when(unknown > 0, "has_unknown").otherwise("pure")


def strata(masks: Mapping[str, Column]) -> Column:
    """The names whose mask holds, to explode."""
    return F.array_compact(F.array(*[F.when(m, F.lit(n)) for n, m in masks.items()]))


def frequency_bin(n: Column) -> Column:
    """1, 2-5, 6-20, >20; null or 0 is unseen."""
    return F.when(n.isNull() | (n <= 0), "unseen").when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").otherwise(">20")


def cut(x: Column, edges: Sequence[float | Column], closed: str = "right", labels: Sequence[str] | None = None) -> Column:
    """Number (or label) of the interval, from 0; null outside the edges and for null or NaN."""
    if closed not in ("left", "right"):
        raise ValueError("closed is left or right")
    at = [e if isinstance(e, Column) else F.lit(float(e)) for e in edges]
    inside = lambda lo, hi: ((x > lo) & (x <= hi)) if closed == "right" else ((x >= lo) & (x < hi))
    return F.coalesce(*[F.when(~F.isnan(x.cast("double")) & inside(lo, hi), F.lit(labels[k] if labels else k)) for k, (lo, hi) in enumerate(zip(at, at[1:], strict=False))])


def code_of(x: Column, codes: Mapping[str, int]) -> Column:
    """Lookup in a fixed map; null where x is unknown, for a violation check."""
    return F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])[x]


def standardized(x: Column, mean: Column, scale: Column, fill: Column | None = None) -> Column:
    """Nulls are filled first."""
    return ((x if fill is None else F.coalesce(x, fill)) - mean) / scale


def unstandardized(z: Column, mean: Column, scale: Column) -> Column:
    """P13, inverse."""
    return z * scale + mean


def anonymous(s: Column, length: int = 12) -> Column:
    """A short stable key that shows nothing of s."""
    return F.substring(F.sha2(s, 256), 1, length)


def classify(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    return F.coalesce(*[F.when(c, F.lit(v)) for c, v in rules], F.lit(otherwise))


def families(key: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """Names that a key maps to; none for an unknown key."""
    entries = [v for k, names in table.items() for v in (F.lit(k), F.array(*map(F.lit, names)))]
    return F.coalesce(F.create_map(*entries)[key], F.array().cast("array<string>"))


def tanimoto(a: Column, b: Column) -> Column:
    """Of two arrays of set bits; two empty ones have 0."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def fingerprint(s: Column, n: int = 3, bits: int = 2048) -> Column:
    """The distinct set bits of hashed character n-grams, sorted; a shorter string is one n-gram, an empty one has none.

    The string is cut into its characters once: a substring by place would read from the start each time, so long texts cost their square."""

    def grams(chars: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
        return F.when(F.size(chars) >= n, windows).when(F.size(chars) > 0, F.array(F.array_join(chars, ""))).otherwise(F.array().cast("array<string>"))

    chars = F.filter(F.split(s, ""), lambda c: c != "")
    found = F.flatten(F.transform(F.array(chars), grams))
    return F.array_sort(F.array_distinct(F.transform(found, lambda g: F.pmod(F.xxhash64(g), F.lit(bits).cast("long")))))


def wall_seconds(start: Column, end: Column) -> Column:
    """Between two ISO strings or timestamps."""
    return F.unix_micros(F.try_to_timestamp(end.cast("string"))) / 1e6 - F.unix_micros(F.try_to_timestamp(start.cast("string"))) / 1e6


def encode_list(a: Column, sep: str = ";") -> Column:
    """Sorted and joined."""
    return F.array_join(F.array_sort(a.cast("array<string>")), sep)


def decode_list(s: Column, sep: str = ";") -> Column:
    """Null or empty: no elements."""
    return F.when(F.coalesce(s, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(s, f"[{sep}]"))


def vector_fault(v: Column) -> Column:
    """Null if the embedding is finite and has a length."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x) == float("inf")))
    return F.when(v.isNull() | (F.size(v) == 0), "missing").when(bad, "not finite").when(norm(v) == 0, "zero norm")


def matches_any(name: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [name.rlike(p) for p in patterns], F.lit(False))


def draw(n: Column, seed: int, *parts: Column) -> Column:
    """An index below n from the first 32 bits of a SHA-256 over seed and parts; any engine can repeat it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % n


def uniform(seed: int, *parts: Column) -> Column:
    """In (0, 1), from the same 32 bits."""
    return (draw(F.lit(1 << 32), seed, *parts) + F.lit(0.5)) / float(1 << 32)
