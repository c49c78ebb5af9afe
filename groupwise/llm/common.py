"""What the training-data operators share: samples by hash and Arrow word splitting; joins and tables come from the library."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupwise.operators.graph import join_counted
from groupwise.storage import stored as keep

__all__ = ["LOWER", "UPPER", "WORD", "ascii_lower", "by_bytes", "hash_share", "join_counted", "keep", "split_words"]

#: A-Z and a-z, for lower-casing that leaves all other letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: words of letters and digits, anything beyond ASCII counting as a letter. It finds the same places before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hash_share(df: DataFrame, keys: list[str], n: float) -> DataFrame:
    """About n rows of df: those whose hash of the keys lies in the lowest n-th of its range. A filter in the scan: no task sorts or sends candidates."""
    total = df.count()
    if total <= n:
        return df
    return df.where(F.xxhash64(*keys) <= F.lit(int(-(1 << 63) + (1 << 64) * (n / total))))


def by_bytes(batch: pa.RecordBatch | pa.Table, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of about `most` bytes of text, so that memory does not follow the batch size; one very long text is a slice of its own."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def split_words(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of A-Z-lower-cased texts (null: empty): start of each text's words (one more than texts) and all words in a row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    flat = pc.fill_null(texts.cast(pa.large_string()), "")
    for space in "\t\n\v\f\r":
        flat = pc.replace_substring(flat, space, " ")
    lists = pc.split_pattern(pc.ascii_lower(flat), " ")  # ascii_lower is wrong on a slice (pyarrow 23); the replaced array is none
    flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    there = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))]).astype(np.int64)
    return kept[ends], flat.filter(there)
