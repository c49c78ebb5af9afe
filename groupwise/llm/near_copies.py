"""The SimHash operator at a Jaccard similarity: near copies by weighted fingerprints, popcount grids and exact verification.

A text is the set of its hashed runs of `shingle` words, A-Z lower-cased; a shorter text is one run, an empty or null one has none.
Texts with the same set are one node. One fingerprint over all shingles does not find pairs at Jaccard 0.8: of 64 bits about ten
differ (in 400 drawn pairs none of 200 shingles was within three bits). So a node has `views` fingerprints. A view orders all
shingles by a hash of its own, and shingle of hash u (0 to 1) in a set of n weighs exp(-tail u n): the few first ones decide most
bits, and the others flip few. A pair at Jaccard 0.8 is within one bit in about a third of the views, so that 24 views miss it
about once in 20,000 times, and rarer above; pairs far below 0.8 seldom meet.

Fingerprints are joined as in near_dedup: bit counts of segments, grids that are joined by equality of cells, the Manhattan
distance as a lower bound, then the exact Hamming distance. Those within one bit are verified by the exact Jaccard similarity of
their sets, so no link is below `least`.

Cells are not paired as they are: each node is first compared with its cell's smallest node, then (where a cell still holds
several components) with one drawn per cell, and only pairs of different components are left for the full join. Pairs inside
a component cannot change it, so these steps lose nothing, and a large group of copies costs linear work. Each step makes the sets of
its own pairs from their texts and deletes them: a text's set is larger than the text, and most texts are in no pair. Nodes of a cell with over `dense` of
them still apart (texts that share a common passage, which decides their fingerprints in this view) are not paired by cells but, all
of them together, by an exact prefix join: with shingles in order from rare to frequent, two sets at `least` or more share one of the first
n - ceil(least n) + 1 of either, and a passage that very many share comes last. So in crowded cells no link is lost at all; the only
ones lost are those that meet in no view, once in 20,000 times at 0.8.

Repeated rows, null ids and repeated ids: rows are told apart by a 128-bit hash of all their columns. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupwise.storage import drop_tables, mark

from .common import by_bytes, join_counted, keep, split_words
from .near_dedup import cells_for, components, grid_places, runs, unary_counts, within

#: Odd multipliers that mix 64 bits.
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M1
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's set starts (one more than texts), and the sets in a row, rising and distinct."""
    starts, words = split_words(texts)
    lengths = np.diff(starts)
    coded = pc.dictionary_encode(words)
    each = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    codes = each[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    counts = np.where(lengths >= shingle, lengths - shingle + 1, np.minimum(lengths, 1))
    of = np.repeat(np.arange(len(lengths)), counts)
    at = starts[:-1][of] + (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts))
    size = np.minimum(lengths[of], shingle)
    hashes = mixed(size.astype(np.uint64))
    for k in range(shingle):
        on = np.flatnonzero(size > k)
        hashes[on] = mixed(hashes[on] * M1 + codes[at[on] + k])
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    first = np.ones(len(of), bool)
    first[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    of, hashes = of[first], hashes[first]
    return np.searchsorted(of, np.arange(len(lengths) + 1)), hashes


def names(starts: np.ndarray, sets: np.ndarray) -> pa.Array:
    """128 bits that name a set: two sums of its mixed hashes."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets ^ m), dtype=np.uint64)]) for m in (M1, M2)]
    both = np.stack([s[starts[1:]] - s[starts[:-1]] for s in sums], axis=1).byteswap()
    return pa.array([b.tobytes() for b in both], pa.binary())


def view_fingerprints(starts: np.ndarray, sets: np.ndarray, views: int, tail: float, cut: float = 25.0, most: int = 1 << 13) -> np.ndarray:
    """(text, view): fingerprints of the texts that have shingles, in order. Weights below exp(-cut) change no bit in practice and are left out.

    A weighed shingle takes 64 numbers, so about `most` of them are weighed at a time, whole texts together."""
    sizes = np.diff(starts)
    some = np.flatnonzero(sizes)
    out = np.zeros((len(some), views), np.uint64)
    n = np.repeat(sizes, sizes).astype(np.float64)
    of = np.repeat(np.arange(len(some)), sizes[some])
    for v in range(views):
        salt = mixed(np.array([v + 1], np.uint64) * M1)
        drawn = (sets ^ salt) * (mixed(salt) | np.uint64(1))
        drawn ^= drawn >> np.uint64(32)
        rank = drawn * M2 * (2.0**-64) * n  # u n: about how many shingles of the set come before
        near = np.flatnonzero(rank < cut / tail)
        hashes, weights = mixed(drawn[near]), np.exp(-tail * rank[near])
        del drawn, rank
        begins = np.searchsorted(of[near], np.arange(len(some)))
        filled = np.flatnonzero(np.diff(np.append(begins, len(near))))
        if not len(filled):  # no text has a shingle of weight here, as where all are empty
            continue
        begins, ends = begins[filled], np.append(begins[filled][1:], len(near))
        for first, stop in runs(ends, most):
            a, b = begins[first], ends[stop - 1]
            bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(np.where(bits, weights[a:b, None], -weights[a:b, None]), begins[first:stop] - a, axis=0)
            out[filled[first:stop], v] = np.packbits((sums > 0).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_lists(starts: np.ndarray, sets: np.ndarray, views: int, tail: float) -> pa.Array:
    ends = np.zeros(len(starts), np.int32)
    ends[1:] = np.cumsum(np.diff(starts) > 0) * views
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(view_fingerprints(starts, sets, views, tail).ravel().view(np.int64)))


def row_hashes(docs: DataFrame) -> list[Column]:
    """h1 and h2: a 128-bit hash of all columns that tells nulls apart."""
    all_of = [*[F.col(f"`{c}`").isNull() for c in docs.columns], *[F.col(f"`{c}`") for c in docs.columns]]
    return [F.xxhash64(*all_of).alias("h1"), F.xxhash64(F.lit(1), *all_of).alias("h2")]


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (src, dst; a written table) whose sets have a Jaccard similarity of `least` or more; a set in very many pairs goes to no single task.
    sets: (node, s, src_pairs, dst_pairs), a written table with the sets of these pairs and in how many of them each is."""

    def with_set(some: DataFrame, end: str, name: str) -> DataFrame:
        found = sets.where(f"{end}_pairs > 0").select(F.col("node").alias(end), F.col("s").alias(name), F.col(f"{end}_pairs").alias("n_pairs"))
        return join_counted(some, found, end, "n_pairs", deal=F.xxhash64("src", "dst")).drop("n_pairs")

    both = with_set(with_set(pairs, "src", "s1"), "dst", "s2")
    common = F.size(F.array_intersect("s1", "s2"))
    return both.where(common / (F.size("s1") + F.size("s2") - common) >= least).select("src", "dst")


#: Counters that estimate in how many sets a shingle is, and the rows that they travel in.
COUNTERS, SLICES = 1 << 20, 64


def by_prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(src, dst), possibly repeated: all pairs of `sets` (node, s, root) of different roots that can have a Jaccard similarity of `least` or more.

    The order of shingles goes by counters that shingles share by hash: a sum over tasks of fixed size, sent to each task. They only need to
    be the same everywhere; the better they tell rare from frequent, the fewer pairs meet."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            place = batch["s"].flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(44)
            total += np.bincount(place.astype(np.int64), minlength=COUNTERS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(total, SLICES)], pa.binary())], names=["slice", "v"])

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // SLICES, np.uint32)
        for x in table["v"].to_pylist():
            total += np.frombuffer(x, np.uint32)
        return pa.table([table["slice"][:1], pa.array([total.tobytes()], pa.binary())], names=["slice", "v"])

    slices = sets.select("s").mapInArrow(counted, "slice int, v binary").groupBy("slice").applyInArrow(summed, "slice int, v binary").collect()  # 4 MB
    joined = b"".join(r.v for r in sorted(slices, key=lambda r: r.slice)) or bytes(4 * COUNTERS)
    shared = sets.sparkSession.sparkContext.broadcast(joined)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.frombuffer(shared.value, np.uint32)
        for batch in batches:
            lists = batch["s"]
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            found = []
            for a, b in zip(ends, ends[1:], strict=False):
                own = flat[a:b]
                order = np.lexsort((own, counters[(own >> np.uint64(44)).astype(np.int64)]))
                found.append(own[order[: max(0, len(own) - int(np.ceil(least * len(own) - 1e-6)) + 1)]])
            many = np.array([len(f) for f in found], np.int64)
            whose = pa.array(np.repeat(np.arange(len(found)), many))
            shingles = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shingles), batch["node"].take(whose), pa.array(np.repeat(np.diff(ends), many)), batch["root"].take(whose)], names=["shingle", "node", "n", "root"])

    rows = keep(sets.select("node", "s", "root").mapInArrow(prefixes, "shingle long, node long, n long, root long"))
    a, b = rows.alias("a"), rows.alias("b").hint("shuffle_merge")
    sizes = F.least("a.n", "b.n") >= least * F.greatest("a.n", "b.n") - 1e-6
    meet = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.node") > F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & sizes
    return a.join(b, meet).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, views: int = 24, tail: float = 0.45, max_bits: int = 1,
    dense: int = 64, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """(h1, h2, id, component) per row: rows of one component are linked by a chain of pairs at Jaccard `least` or more."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                starts, sets = shingle_sets(part["text"], shingle)
                made = [names(starts, sets), pa.array(np.diff(starts)), fingerprint_lists(starts, sets, views, tail)]
                yield pa.RecordBatch.from_arrays([part["h1"], part["h2"], part["id"], *made], names=["h1", "h2", "id", "node", "n", "fps"])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                starts, sets = shingle_sets(part["text"], shingle)
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part["node"], lists, *[part[c] for c in counts]], names=["node", "s", *counts])

    counts = ("src_pairs", "dst_pairs")
    source = docs.select(*row_hashes(docs), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    drawn = keep(source.mapInArrow(sketch, "h1 long, h2 long, id long, node binary, n long, fps array<long>"))
    named = drawn.groupBy(F.col("node").alias("name")).agg(F.min(F.struct("h1", "h2")).alias("row"), F.first("n").alias("n"), F.first("fps").alias("fps"), F.count("*").alias("rows"))
    nodes = keep(named.withColumn("node", F.monotonically_increasing_id()))  # written, so the numbers stay
    cells = cells_for(nodes.count(), max_bits)
    seen = nodes.select("node", "n", F.posexplode("fps").alias("view", "fp")).withColumn("counts", unary_counts(F.col("fp")))
    placed = seen.select("node", "n", "fp", "view", F.inline(grid_places(cells, max_bits))).withColumn("code", F.xxhash64("view", "grid", "cell")).select("node", "n", "fp", "code")
    hubs = keep(placed.groupBy("code").agg(F.min(F.struct("node", "n", "fp")).alias("hub"), F.count("*").alias("many")).where("many > 1"))
    shared = keep(join_counted(placed, hubs, "code", "many", deal=F.col("node")).drop("many"))

    def sets_of(asked: DataFrame) -> DataFrame:
        """(node, s, src_pairs, dst_pairs), written: the sets of the nodes in `asked` (node, src_pairs, dst_pairs) alone, made from their texts again. Only
        texts that are asked for are shuffled, while up to `broadcast_rows` are; then all of them, but no set is."""
        wanted = keep(nodes.select("node", "row.h1", "row.h2").join(asked.hint("shuffle_hash"), "node"))
        small = wanted.count() <= broadcast_rows
        found = source.select("h1", "h2", "text").join(wanted.hint("broadcast" if small else "shuffle_hash"), ["h1", "h2"])
        once = found.dropDuplicates(["h1", "h2"]).select("node", "text", *counts)  # rows that are equal in all columns
        return keep(once.mapInArrow(contents, "node long, s array<long>, src_pairs long, dst_pairs long"))

    def verify(pairs: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """Those of the pairs that are alike, written after the edges found before; the sets are deleted."""
        since = mark()
        pairs = keep(pairs)
        ends = pairs.select(F.inline(F.array(*[F.struct(F.col(end).alias("node"), *[F.lit(int(c == f"{end}_pairs")).cast("long").alias(c) for c in counts]) for end in ("src", "dst")])))
        found = verified(pairs, sets_of(ends.groupBy("node").agg(*[F.sum(c).alias(c) for c in counts])), least)
        out = keep(found if before is None else before.union(found))
        drop_tables(docs.sparkSession, since, spare=1)
        return out

    def alike(a: str, b: str) -> Column:
        """What two members of a cell must pass before their sets are compared: sizes, Manhattan distance of counts, Hamming distance."""
        sizes = F.least(f"{a}.n", f"{b}.n") >= least * F.greatest(f"{a}.n", f"{b}.n") - 1e-6
        manhattan = F.bit_count(unary_counts(F.col(f"{a}.fp")).bitwiseXOR(unary_counts(F.col(f"{b}.fp")))) <= max_bits
        return sizes & manhattan & within(f"{a}.fp", f"{b}.fp", max_bits)

    def to_hub(d: DataFrame) -> DataFrame:
        pairs = d.select(F.struct("node", "n", "fp").alias("own"), "hub").where(F.col("own.node") != F.col("hub.node")).where(alike("own", "hub"))
        return pairs.select(F.greatest("own.node", "hub.node").alias("src"), F.least("own.node", "hub.node").alias("dst")).distinct()

    def still_apart(members: DataFrame, found: DataFrame | None = None) -> DataFrame:
        """The members with their component (root), in cells that hold more than one."""
        if found is not None:
            members = members.select("code", "node", "n", "fp").join(found.hint("shuffle_merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        known = keep(members)
        held = known.groupBy("code").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("many"))
        return keep(join_counted(known, held.where("lo <> hi").select("code", "many"), "code", "many"))

    edges = verify(to_hub(shared))
    rest = still_apart(shared, components(edges)).drop("many")
    drawn_hub = F.min(F.struct(F.xxhash64("code", "node"), "node", "n", "fp", "root")).alias("hub")
    second = rest.groupBy("code").agg(drawn_hub, F.count("*").alias("many"))
    others = join_counted(rest, second, "code", "many").where(F.col("root") != F.col("hub.root"))
    edges = verify(to_hub(others), edges)
    rest = still_apart(rest.drop("root"), components(edges))
    few = rest.where(F.col("many") <= dense)
    a, b = few.alias("a"), few.alias("b").hint("shuffle_merge")
    meet = (F.col("a.code") == F.col("b.code")) & (F.col("a.node") > F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & alike("a", "b")
    met = a.join(b, meet).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))
    crowd = keep(rest.where(F.col("many") > dense).select("node", "root").distinct())
    since = mark()
    sets = sets_of(crowd.select("node", *[F.lit(0).cast("long").alias(c) for c in counts]))
    how = "broadcast" if crowd.count() <= broadcast_rows else "shuffle_merge"
    pairs = keep(met.union(by_prefixes(sets.join(crowd.hint(how), "node"), least)).distinct())
    drop_tables(docs.sparkSession, since, spare=1)
    found = components(verify(pairs, edges))
    roots = nodes.select("name", "node", "rows").join(found.hint("shuffle_merge"), "node", "left").select(F.col("name").alias("node"), "rows", F.coalesce("root", "node").alias("component"))
    return join_counted(drawn, keep(roots), "node", "rows").select("h1", "h2", "id", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs without near copies: of each component one row, the one with the smallest id (null last, then by the hash of its columns)."""
    groups = near_copies(docs, id_col, text_col, **how)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2")
    chosen = groups.groupBy("component").agg(F.min(order).alias("w")).select("w.h1", "w.h2")
    keyed = docs.select(*docs.columns, *row_hashes(docs))
    return keyed.join(chosen.hint("shuffle_hash"), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select(docs.columns)
