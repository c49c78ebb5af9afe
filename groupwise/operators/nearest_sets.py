"""For each set the most similar one of other sets (Tanimoto), exactly or among those that share a MinHash code.

A set is packed once: its bits among the frequent ones (the columns, a bounded vocabulary) as a bitmap, the others as a list. A task that
compares two blocks of sets counts frequent columns by a matrix product and joins the entries of rare ones, so nothing is looked up or
sorted again for the blocks that a block meets. What a set can have in common with the sets of a cluster (k-means of a sample of bitmaps) is bounded by its bits
among the usual ones of the cluster and by how many bits the others have beside these; pairs whose bound is not above the best found are not
compared. The sample, the vocabulary and the clusters decide what is read first and left out by proof, never the result."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupwise.storage import stored

EMPTY = pa.table([pa.array([], pa.int64()), pa.array([], pa.float64())], names=["id", "nearest"])
#: Bits that a share of this of the sampled sets have become columns, and at most so many; more clusters than kinds of sets cost little.
FREQUENT, COLUMNS, CLUSTERS, USUAL = 0.01, 1 << 14, 8, 0.05
#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def fingerprint_sets(df: DataFrame, text: str, n: int = 3, bits: int = 1 << 40, out: str = "bits") -> DataFrame:
    """df with scalar.fingerprint of a text column in place of the column, made batch by batch: windows of a text are told apart by their code points, and each different one is hashed once."""
    if not 1 <= n <= 3:
        raise ValueError("n is 1 to 3: three code points fit a long")
    others = [c for c in df.columns if c != text]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        for batch in batches:
            lists = []
            for t in batch.column(len(others)):
                chars = np.frombuffer((t.as_py() or "").encode("utf-32-le"), np.uint32).astype(np.int64)
                codes = np.zeros(max(1, len(chars) - n + 1) if len(chars) else 0, np.int64)
                for k in range(min(n, len(chars))):
                    codes = (codes << 21) | (chars[k : k + len(codes)] + 1)  # a shorter text has no code of a longer window
                grams = np.unique(codes).tolist()
                for g in grams:
                    if g not in known:
                        known[g] = xxhash.xxh64_intdigest("".join(chr(((g >> s) & 0x1FFFFF) - 1) for s in (42, 21, 0) if g >> s), 42) % bits
                lists.append(np.unique(np.array([known[g] for g in grams], np.int64)))
                if len(known) > 1 << 20:
                    known.clear()
            ends = np.cumsum([0, *map(len, lists)])
            made_of = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], made_of], names=[*others, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*others).schema)
    return df.select(*others, F.col(text).cast("string").alias("_text")).mapInArrow(made, f"{kinds}, `{out}` array<bigint>")


def _hashed(values: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """Spark's xxhash64 of longs behind a seed."""
    v = values.view(np.uint64) * P2
    h = (np.asarray(seed).astype(np.uint64) + P5 + np.uint64(8)) ^ (((v << np.uint64(31)) | (v >> np.uint64(33))) * P1)
    return _final(((h << np.uint64(27)) | (h >> np.uint64(37))) * P1 + P4)


def _final(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def minhash_codes(starts: np.ndarray, flat: np.ndarray, tables: int, rows: int) -> np.ndarray:
    """(set, table): xxhash64 of `rows` MinHashes, each the least xxhash64(k, bit) of a set, as Spark computes them. No set is empty."""
    hashed = np.array([42], np.uint64) + P5 + np.uint64(4)
    ks = (hashed ^ (np.arange(tables * rows, dtype=np.uint64) * P1)).reshape(tables, rows)
    seeds = _final(((ks << np.uint64(23)) | (ks >> np.uint64(41))) * P2 + P3)
    out = np.full((len(starts) - 1, tables), 42, np.uint64)
    for t in range(tables):
        for r in range(rows):
            least = np.minimum.reduceat(_hashed(flat, seeds[t, r]).view(np.int64), starts[:-1])
            out[:, t] = _hashed(least, out[:, t])
    return out.view(np.int64)


@dataclass
class Layout:
    """The vocabulary (rising), and the share of each of its bits in the sampled sets of each cluster."""

    columns: np.ndarray
    shares: np.ndarray

    def packed(self, lists: pa.ListArray, tables: int = 0, rows: int = 0) -> Iterator[tuple[int, int, dict[str, pa.Array]]]:
        """For slices from a to b of sets (rising distinct longs): n, cluster, inside (bits among the usual ones of each cluster), fp, rest, and codes if asked for."""
        ends = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False)
        width = len(self.columns)
        usual = (self.shares >= USUAL).astype(np.float32).T
        towards = (self.shares / np.maximum(np.sqrt((self.shares**2).sum(axis=1, keepdims=True)), 1e-9)).astype(np.float32).T
        a = 0
        while a < len(lists):
            b = max(a + 1, min(len(lists), a + max(1, (1 << 22) // max(width, 1)), int(np.searchsorted(ends, ends[a] + (1 << 16), side="right")) - 1))
            n, flat = np.diff(ends[a : b + 1]), values[ends[a] : ends[b]]
            of = np.repeat(np.arange(b - a), n)
            at = np.minimum(np.searchsorted(self.columns, flat), max(0, width - 1))
            on = self.columns[at] == flat if width else np.zeros(len(flat), bool)
            has = np.zeros((b - a, width), np.uint8)
            has[of[on], at[on]] = 1
            inside = (has.astype(np.float32) @ usual).astype(np.int32)
            left = np.concatenate([[0], np.cumsum(np.bincount(of[~on], minlength=b - a))])
            out = {
                "n": pa.array(n.astype(np.int32)),
                "cluster": pa.array((has.astype(np.float32) @ towards).argmax(axis=1).astype(np.int32)),
                "inside": pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * inside.shape[1]), pa.array(inside.ravel())),
                "fp": pa.array([x.tobytes() for x in np.packbits(has, axis=1)], pa.binary()),
                "rest": pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(flat[~on])),
            }
            if tables:
                codes = minhash_codes(ends[a : b + 1] - ends[a], flat, tables, rows)
                out["codes"] = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
            yield a, b, out
            a = b


PACKED = "n int, cluster int, inside array<int>, fp binary, rest array<long>"


def _packed(d: DataFrame, layout: Layout, step: float, key: str = "", tables: int = 0, rows: int = 0) -> DataFrame:
    """(key, id, packed columns, class) of d (key, s), written; an empty or null set has a row only if there is a key. class: cluster and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, made in layout.packed(batch["s"], tables, rows):
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), *made.values()], names=["id", *made])

    sets = d.where(F.size("s") > 0).select(F.xxhash64("s").alias("id"), "s")
    made = sets.mapInArrow(run, f"id long, {PACKED}" + (", codes array<long>" if tables else ""))
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / step) + 1e-9).cast("int")
    return stored(made.dropDuplicates(["id"]).withColumn("class", F.col("cluster") * 1000 + size_class))


def _layout(sets: DataFrame, total: int, sample: int = 5_000, drawn: int = 1_000) -> Layout:
    """From about `sample` of the `total` sets (id, s) the frequent bits, from about `drawn` bitmaps the clusters: both bound what the driver holds."""
    part = lambda d, share: d if share >= 1 else d.where(F.col("id") <= F.lit(int(-(1 << 63) + (1 << 64) * share)))
    some = stored(part(sets, sample / total))
    n = some.count()
    counted = some.select(F.explode("s").alias("bit")).groupBy("bit").agg(F.count("*").alias("many")).where(F.col("many") >= max(2, FREQUENT * n))
    columns = np.sort(np.array([r.bit for r in counted.orderBy(F.desc("many"), "bit").limit(COLUMNS).collect()], np.int64))
    plain = Layout(columns, np.zeros((1, len(columns))))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, made in plain.packed(batch["s"]):
                yield pa.RecordBatch.from_arrays([made["fp"]], names=["fp"])

    rows = part(some, drawn / total).select("s").mapInArrow(bitmaps, "fp binary").collect()
    if not len(columns) or not rows:
        return plain
    has = np.unpackbits(np.frombuffer(b"".join(r.fp for r in rows), np.uint8).reshape(len(rows), -1), axis=1)[:, : len(columns)].astype(np.float32)
    units = has / np.maximum(np.sqrt(has.sum(axis=1, keepdims=True)), 1)
    chosen, far = [int(has.sum(axis=1).argmax())], np.full(len(units), 2.0)
    for _ in range(min(CLUSTERS, len(units)) - 1):
        far = np.minimum(far, 1 - units @ units[chosen[-1]])
        chosen.append(int((far * np.sqrt(has.sum(axis=1))).argmax()))
    centres = units[chosen]
    for _ in range(10):
        own = (units @ centres.T).argmax(axis=1)
        centres = np.stack([units[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.sqrt((centres**2).sum(axis=1, keepdims=True)), 1e-9)
    own = (units @ centres.T).argmax(axis=1)
    return Layout(columns, np.stack([has[own == c].mean(axis=0) for c in np.unique(own)]))


def _highest(n, inside, lo, hi, rest):
    """The largest similarity of a set of n bits, `inside` of them usual, to a set of lo to hi bits, at most `rest` of them not usual."""
    common = np.minimum(inside + np.minimum(n - inside, rest), np.minimum(n, hi))
    return common / np.maximum(n + lo - common, n)


def _meetings(common: np.ndarray, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], most: int) -> None:
    """Add one to common[i, j] for each code that entries (code, i) and (code, j) share; about `most` of them at a time."""
    order = np.argsort(right[0], kind="stable")
    codes, whose = right[0][order], right[1][order]
    a, b = (np.searchsorted(codes, left[0], side=s) for s in ("left", "right"))
    on = np.flatnonzero(b > a)
    a, many, row = a[on], (b - a)[on], left[1][on]
    ends, flat, x = np.cumsum(many), common.reshape(-1), 0
    while x < len(on):
        before = ends[x - 1] if x else 0
        y = max(x + 1, int(np.searchsorted(ends, before + most, side="right")))
        k = many[x:y]
        at = np.repeat(a[x:y] - (ends[x:y] - k - before), k) + np.arange(ends[y - 1] - before)
        places = np.repeat(row[x:y], k) * common.shape[1] + whose[at]
        if len(places) * 8 < len(flat):
            np.add.at(flat, places, 1)
        else:
            flat += np.bincount(places, minlength=len(flat)).astype(np.int32)
        x = y


def _words(t: pa.Table) -> np.ndarray:
    """(set, column): the bitmaps of a block, a byte each bit."""
    return np.unpackbits(np.frombuffer(b"".join(t["fp"].to_pylist()), np.uint8).reshape(t.num_rows, -1), axis=1)


def _common(left: pa.Table, right: pa.Table, words: list[np.ndarray], cells: int, often: float) -> np.ndarray:
    """How many bits each set of the left block has in common with each of the right one. Columns that are frequent in both are counted by
    matrix products, in slices of at most `cells` bytes; entries of the others, and of bits without a column, are joined."""
    shape = (left.num_rows, right.num_rows)
    many = [w.sum(axis=0, dtype=np.int64) for w in words]
    meet, most = many[0] * many[1], max(1, cells // 8)
    dense = meet >= max(1.0, often**2 * shape[0] * shape[1])
    common, places, step = np.zeros(shape, np.int32), np.flatnonzero(dense), max(1, cells // (4 * max(shape)))
    for k in range(0, len(places), step):
        x, y = (w[:, places[k : k + step]].astype(np.float32) for w in words)
        common += (x @ y.T).astype(np.int32)  # whole numbers below 2^24 are exact
    thin = np.flatnonzero(~dense & (meet > 0))
    if len(thin):
        _meetings(common, *[np.nonzero(w[:, thin].view(bool))[::-1] for w in words], most)
    rest = [t["rest"].combine_chunks() for t in (left, right)]
    _meetings(common, *[(r.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(r)), np.diff(r.offsets.to_numpy()))) for r in rest], most)
    return common


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    return t[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _better(left: pa.Table, right: pa.Table, cells: int = 1 << 25, often: float = 0.04, piece: int = 1 << 21) -> pa.Table:
    """(id, nearest) of the sets of the left block that a set of the right one (all of one cluster) is more alike than `best`; where both have `codes`, one that has
    a code of its own in the same place."""
    cluster = right["cluster"][0].as_py()
    n, m = (t["n"].to_numpy().astype(np.int64) for t in (left, right))
    inside, best = _matrix(left, "inside")[:, cluster], left["best"].to_numpy()
    rest = m - _matrix(right, "inside")[:, cluster]
    rows = np.flatnonzero(_highest(n, inside, m.min(), m.max(), rest.max()) > best)
    if not len(rows):
        return EMPTY
    out, step, words = [], max(1, piece // len(m)), _words(right)
    single = lambda *d: [x.astype(np.float32) for x in d]
    for a in range(0, len(rows), step):
        at = rows[a : a + step]
        mine, its = single(n[at, None], inside[at, None]), single(m[None], m[None], rest[None])
        hope = _highest(*mine, *its) > single(best[at, None] * (1 - 1e-6))[0]  # below what rounding can change
        cols, at = np.flatnonzero(hope.any(axis=0)), at[hope.any(axis=1)]
        if not len(at):
            continue
        x, y = left.take(pa.array(at)), right.take(pa.array(cols))
        common = _common(x, y, [_words(x), words[cols] if len(cols) < len(m) else words], cells, often)
        alike = common / (n[at, None] + m[None, cols] - common)
        value = alike.max(axis=1)
        if "codes" in left.column_names:
            value = _best_met(alike, _matrix(x, "codes"), _matrix(y, "codes"), best[at])
        found = value > best[at]
        out.append(pa.table([x["id"].filter(pa.array(found)), pa.array(value[found])], names=EMPTY.column_names))
    return pa.concat_tables([EMPTY, *out])


def _best_met(alike: np.ndarray, own: np.ndarray, other: np.ndarray, best: np.ndarray, tries: int = 8) -> np.ndarray:
    """For each row the largest value above best among those that share a code in its place, else -1: the largest ones are tried first."""
    value, open_ = np.full(len(alike), -1.0), np.arange(len(alike))
    for _ in range(tries):
        at = alike[open_].argmax(axis=1)
        top = alike[open_, at]
        met = (own[open_] == other[at]).any(axis=1) & (top > best[open_])
        value[open_[met]] = top[met]
        alike[open_, at] = -1
        open_ = open_[~met & (top > best[open_])]
    for i in open_:
        met = (own[i][None] == other).any(axis=1)
        value[i] = alike[i][met].max(initial=-1.0)
    return value


def _block_best(left: pa.Table, right: pa.Table, cells: int = 1 << 25, often: float = 0.04) -> pa.Table:
    """For each set (id, s) of the left block the largest similarity to a set of the right one, without bounds or what was found before."""
    bits, many = np.unique(right["s"].combine_chunks().flatten().to_numpy(zero_copy_only=False), return_counts=True)
    bits = bits[np.sort(np.argsort(-many, kind="stable")[:COLUMNS])]
    plain, sides = Layout(bits, np.zeros((1, len(bits)))), []
    for t in (left, right):
        lists = t["s"].combine_chunks()
        slices = [pa.table(made).append_column("id", t["id"].slice(a, b - a)) for a, b, made in plain.packed(lists)]
        sides.append(pa.concat_tables(slices).append_column("best", pa.array(np.full(len(lists), -1.0))).combine_chunks())
    return _better(*sides, cells, often)


def _in_blocks(d: DataFrame, blocks: Column, n: int, *columns: str) -> DataFrame:
    """(class, block, sets, needs), written: the rows of each class dealt into `blocks` blocks by id, one row a block; n blocks in all."""
    dealt = d.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    parts = min(n, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    needs = [F.array_distinct(F.flatten(F.collect_set("needs"))).alias("needs")] if "needs" in d.columns else []
    return stored(dealt.repartition(parts, "class", "block").groupBy("class", "block").agg(F.collect_list(F.struct("id", "n", "cluster", "inside", "fp", "rest", *columns)).alias("sets"), *needs))


def _met_in_blocks(left: DataFrame, right: DataFrame, meet: Column) -> DataFrame:
    """(id, nearest): what is better than the best known of the sets of the left blocks in all right blocks for which `meet` holds. Each task reads
    some blocks of both written tables and compares them pair by pair: no set is shuffled or written again for the blocks that it meets."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = [batch[c].slice(i, 1).flatten() for c in ("q", "t")]
                yield from _better(*[pa.table(s.flatten(), names=[f.name for f in s.type]) for s in sides]).combine_chunks().to_batches()

    pairs = left.alias("q").join(right.alias("t").hint("shuffle_replicate_nl"), meet).select(F.col("q.sets").alias("q"), F.col("t.sets").alias("t"))
    return stored(pairs.mapInArrow(compared, "id long, nearest double").groupBy("id").agg(F.max("nearest").alias("nearest")))


def _search(q: DataFrame, t: DataFrame, step: float, block_rows: int, block_bits: int, codes: bool = False) -> DataFrame:
    """(id, nearest) for the packed sets q that have a value above 0 in t, in two rounds: the first compares sets of one cluster and like size, the second all
    others that the bounds leave, block by block."""
    columns = ["codes"] if codes else []
    most = lambda c: max(1, min(block_rows, int(block_bits * step ** (c % 1000 + 1))))

    def blocked(d: DataFrame, size_of: int = 1, more: tuple[str, ...] = ()) -> DataFrame:
        many = {r["class"]: math.ceil(r["count"] / most(r["class"] // size_of)) for r in d.groupBy("class").count().collect()}  # a number for each class
        return _in_blocks(d, F.create_map(*[F.lit(x) for kv in many.items() for x in kv])[F.col("class")], sum(many.values()), *columns, *more) if many else _in_blocks(d, F.lit(1), 1, *columns, *more)

    kinds = t.groupBy("class").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.get("inside", "cluster")).alias("rest")).orderBy("class").collect()
    code, lo, hi, rest = (np.array([r[i] for r in kinds], np.int64) for i in range(4))
    blocks = blocked(t)
    first = _met_in_blocks(blocked(q.withColumn("best", F.lit(0.0)), 1, ("best",)), blocks, F.abs(F.col("q.class") - F.col("t.class")) <= 1)

    def hoped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                n, own, best = (table[c].to_numpy().astype(float)[:, None] for c in ("n", "class", "best"))
                wanted = (_highest(n, _matrix(table, "inside")[:, code // 1000], lo, hi, rest) > best) & (np.abs(own - code) > 1)
                needs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(wanted.sum(axis=1))), pa.int32()), pa.array(code[np.nonzero(wanted)[1]].astype(np.int32)))
                yield from table.append_column("needs", needs).to_batches()

    known = q.join(first.hint("shuffle_hash"), "id", "left").withColumn("best", F.coalesce("nearest", F.lit(0.0))).drop("nearest")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema)
    left = known.mapInArrow(hoped, f"{kind}, needs array<int>").where(F.size("needs") > 0)
    left = stored(left.withColumn("class", (F.col("class") * 10 + F.least(F.floor(F.col("best") * 10), F.lit(9))).cast("int")))  # those with a like best share a block
    second = _met_in_blocks(blocked(left, 10, ("best",)), blocks, F.array_contains("q.needs", F.col("t.class")))
    return first.unionAll(second).groupBy("id").agg(F.max("nearest").alias("nearest"))


def _found(query: DataFrame, train: DataFrame, key: str, bits: str, step: float, block_rows: int, block_bits: int, tables: int, rows: int) -> DataFrame:
    s = F.sort_array(F.array_distinct(bits)).alias("s")
    named = stored(query.select(F.col(key).alias("_key"), s).withColumn("id", F.when(F.size("s") > 0, F.xxhash64("s"))))
    filled = train.where(F.size(bits) > 0)
    sets, total = filled.select(s).withColumn("id", F.xxhash64("s")), filled.count()
    answer = lambda found: named.join(found.hint("shuffle_merge"), "id", "left").select(F.col("_key").alias(key), F.coalesce("nearest", F.lit(0.0)).alias("nearest"))
    if not total:
        return named.select(F.col("_key").alias(key), F.lit(0.0).alias("nearest"))
    layout = _layout(sets, total)
    q, t = (_packed(d, layout, step, key, tables, rows) for d in (named, sets))
    found = stored(_search(q, t, step, block_rows, block_bits, tables > 0))
    if tables:
        alone = q.drop("codes").join(found.hint("shuffle_merge"), "id", "left_anti")
        alone = stored(alone)
        if not alone.isEmpty():
            found = found.unionAll(_search(alone, t.drop("codes"), step, block_rows, block_bits))
    return answer(found)


def nearest_similarity(query: DataFrame, train: DataFrame, key: str, bits: str = "bits", step: float = 0.8, block_rows: int = 2000, block_bits: int = 1 << 22) -> DataFrame:
    """J10, exact: (key, nearest) for each row of query, the largest Tanimoto similarity to a distinct bit set of train; 0 without a common bit.

    Distinct sets are compared once. They fall into classes of one cluster and like size, each size 1/step times the one before. A query first meets
    its own class and those beside it, then the classes that can still hold a better set. Sets are packed into blocks of about `block_rows` sets and
    `block_bits` bits, written once (those of queries once a round), and tasks read the blocks that they compare; classes are split into
    blocks by their counts, so none is a hot key. So disk and shuffle follow the input. The comparisons left are all pairs of like sets by nature."""
    return _found(query, train, key, bits, step, block_rows, block_bits, 0, 0)


def minhash_nearest(query: DataFrame, train: DataFrame, key: str, bits: str = "bits", tables: int = 24, rows: int = 2, block_rows: int = 2000, block_bits: int = 1 << 22) -> DataFrame:
    """J10, approximate: (key, nearest). Sets that agree in one of `tables` codes, each of `rows` MinHashes, are compared exactly.

    A neighbour at similarity s is missed with probability (1 - s^rows)^tables. Queries that meet no set at all are searched exactly,
    so no query is left without an answer. Null or empty sets have 0. Texts of one language share so many bits that most pairs meet, so codes are
    looked at last: inside blocks, for the most similar sets that a query has there."""
    return _found(query, train, key, bits, 0.8, block_rows, block_bits, tables, rows)
