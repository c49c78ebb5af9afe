"""SimHash near-duplicate groups by a grid join over segment bit counts.

A 64-bit fingerprint is cut into 32 segments of two bits, and each segment is mapped to its bit count (0, 1 or 2). Written in
unary (00, 01, 11), the 32 counts are one long whose Hamming distance is the Manhattan distance of the counts. Changing one
bit changes one count by one, so that distance never exceeds the Hamming distance of the fingerprints: a lower bound.

Grid range join: the counts are cut into equal parts (`cells`). Two points at Manhattan distance d or less differ in at most d
parts, so they agree in at least cells - d of them; each choice of that many parts is a grid whose cells are joined by
equality. Pairs of a cell pass the Manhattan bound and then the exact Hamming test, both inside the join. `cells` follows the number
of distinct fingerprints: so many that a cell holds less than one by chance, at any size.

A cell can still hold many: copies that differ in a few bits. Over `dense` of them are not paired. There each fingerprint goes to
the 65 codes within one bit of it. Two fingerprints that meet in a code differ by at most two bits, and any two that differ by at most
two bits meet in one, so linking all of a code to its smallest member finds exactly the same groups with linear work.

Empty text or null: fingerprint zero, linked like any other. Repeated rows give repeated result rows. A null id takes part like
any other row; a component's name is its smallest id, and null only where it holds no other. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupwise.operators.graph import star_components as components

from .common import by_bytes, join_counted, keep, split_words

ODD = 0x5555555555555555


def bits_over_half(hashes: np.ndarray, counts: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """One fingerprint per run of hashes: a bit is 1 if it is set in over half of them; a run of length zero gives zero."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    ends = np.cumsum(counts[some])
    done = 0
    for first in runs(ends, most):
        last = ends[first[1] - 1]
        bits = np.unpackbits(hashes[done:last].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], ends[first[0] : first[1] - 1] - done]).astype(np.int64)
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        set_ = (2 * ones > counts[some[first[0] : first[1]]][:, None]).astype(np.uint8)
        out[some[first[0] : first[1]]] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
        done = last
    return out


def runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start = stop


def simhash_texts(texts: pa.Array, shingle: int) -> np.ndarray:
    starts, words = split_words(texts)
    lengths = np.diff(starts)
    counts = np.where(lengths >= shingle, lengths - shingle + 1, np.minimum(lengths, 1))
    of = np.repeat(np.arange(len(lengths)), counts)
    at = starts[:-1][of] + (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts))
    long = lengths[of] >= shingle
    hashes = np.zeros(len(of), np.uint64)
    if long.any():
        joined = pc.binary_join_element_wise(*[words.take(pa.array(at[long] + k)) for k in range(shingle)], pa.scalar(" ", pa.large_string()))
        hashes[long] = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in joined.to_pylist()), np.uint64, int(long.sum()))
    for i in np.flatnonzero(~long):
        d = of[i]
        hashes[i] = xxhash.xxh64_intdigest(" ".join(words.slice(starts[d], lengths[d]).to_pylist()), 42)
    return bits_over_half(hashes, counts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the 64-bit SimHash of the whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(simhash_texts(part["text"], shingle).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def unary_counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in unary."""
    high, odd = F.shiftrightunsigned(fp, 1), F.lit(ODD)
    return F.shiftleft(fp.bitwiseAND(high).bitwiseAND(odd), 1).bitwiseOR(fp.bitwiseOR(high).bitwiseAND(odd))


def masks(cells: int, max_bits: int) -> list[int]:
    """A mask over the unary counts for each choice of cells - max_bits parts, as signed longs."""
    width = 32 // cells * 2
    part = [((1 << (64 if k == cells - 1 else (k + 1) * width)) - 1) ^ ((1 << k * width) - 1) for k in range(cells)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(part[k] for k in kept) for kept in combinations(range(cells), cells - max_bits))]


def cells_for(n: int, max_bits: int) -> int:
    """Parts of the counts for n points: a cell's key has 1.5 bits of information a segment, and they reach 4 n cells."""
    need = math.log2(max(n, 1)) + 2
    return next((c for c in range(max_bits + 1, 17) if c >= 2 and 48 * (c - max_bits) / c >= need), 16)


def grid_places(cells: int, max_bits: int) -> Column:
    """array of (grid, cell) for the column `counts`."""
    return F.array(*[F.struct(F.lit(k).alias("grid"), F.col("counts").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks(cells, max_bits))])


def within(x: str, y: str, max_bits: int) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= max_bits


def code_stars(crowd: DataFrame, max_bits: int) -> DataFrame:
    """(src, dst) that connect the fingerprints of crowded cells, by codes within one bit of each; see the module's text."""
    step = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64 if max_bits > 0 else 0)])
    met = keep(crowd.select("node", "fp", F.explode(step).alias("s")).select("node", F.col("fp").bitwiseXOR(F.col("s")).alias("code")))
    if max_bits < 2:  # two fingerprints at one bit meet in each other's codes, not in a third one
        other = crowd.select(F.col("node").alias("other"), F.col("fp").alias("code"))
        found = met.join(other.hint("shuffle_merge"), "code")
        return found.select(F.greatest("node", "other").alias("src"), F.least("node", "other").alias("dst"))
    first = keep(met.groupBy("code").agg(F.min("node").alias("dst"), F.count("*").alias("n")).where("n > 1"))
    return join_counted(met, first, "code", "n").select(F.col("node").alias("src"), "dst")


def links(nodes: DataFrame, cells: int | None = None, max_bits: int = 2, dense: int = 64) -> DataFrame:
    """(src, dst) of `nodes` (node, fp; fp distinct) that connect what differs by at most max_bits (at most 2). See the module's text."""
    cells = cells or cells_for(nodes.count(), max_bits)
    if not 0 <= max_bits <= 2 or not max_bits < cells <= 16:
        raise ValueError("max_bits is 0 to 2, cells is over max_bits and at most 16")
    placed = nodes.withColumn("counts", unary_counts(F.col("fp"))).select("node", "fp", "counts", F.inline(grid_places(cells, max_bits))).withColumn("place", F.xxhash64("grid", "cell"))
    filled = keep(placed.groupBy("place").agg(F.count("*").alias("n")).where("n > 1"))
    shared = keep(join_counted(placed, filled, "place", "n", deal=F.col("node")))  # a crowded cell goes to many tasks
    sparse, crowd = shared.where(F.col("n") <= dense), shared.where(F.col("n") > dense)
    a, b = sparse.alias("a"), sparse.alias("b").hint("shuffle_merge")
    same = (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.node") > F.col("b.node"))
    near = same & within("a.counts", "b.counts", max_bits) & within("a.fp", "b.fp", max_bits)
    pairs = a.join(b, near).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))
    crowd = keep(crowd.select("node", "fp").distinct())
    return pairs.union(code_stars(crowd, max_bits)).where("src <> dst").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, cells: int | None = None, max_bits: int = 2, dense: int = 64) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most max_bits differing bits, itself included."""
    prints = keep(fingerprints(docs, id_col, text_col, shingle))
    # Fingerprints are the nodes; the ids come back at the end, so a null or repeated id changes no link.
    nodes = keep(prints.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("node", F.col("fp")))
    found = components(links(nodes.select("node", "fp"), cells, max_bits, dense))
    rooted = keep(nodes.join(found.hint("shuffle_merge"), "node", "left").select("fp", "id", "n", F.coalesce("root", "node").alias("root")))
    named = keep(rooted.groupBy("root").agg(F.min("id").alias("component"), F.count("*").alias("many")))
    roots = keep(join_counted(rooted, named, "root", "many").select("fp", "component", "n"))
    return join_counted(prints, roots, "fp", "n").select("id", "fp", "component")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
