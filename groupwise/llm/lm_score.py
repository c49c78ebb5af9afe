"""LM scoring by a weighted backoff automaton.

Model: n-grams over words and one end token. p(w) = (c(w) + add) / (N + add (V + 1)); longer n-grams are smoothed by a Dirichlet
prior on the next shorter one, p(w | h) = (c(h w) + prior p(w | h')) / (c(h) + prior), h' being h without its first word.

Automaton: every context of the training texts is a state; the root is the empty context. A seen n-gram is an arc of its context
with the log-probability as cost, and it leads to the longest context that the tokens read so far end in. Where a state has no arc
for a token, its failure arc leads to h' at the cost of log(prior / (c(h) + prior)) without reading; the root has an arc for every
token. Summed over all next tokens, the probabilities of a state are exactly 1. A text is read once from left to right: it carries its
state from token to token and adds up the costs. All texts of a block step together. A text of over `run` tokens is read in
pieces; a piece first reads the order - 1 tokens before it, after which its state is what one reading would carry.

The automaton of a large corpus fits no machine, so each block of documents (a hash of id and text; sized by characters) builds the
part that its own texts can reach:
1. each block reads its texts batch by batch, keeps their tokens alone and lists its distinct n-grams, level by level, as sorted 64-bit hashes with their training counts, cut by hash range into `fan` pieces;
2. `fan` blocks' pieces of one range meet and are added up; with more than `fan` blocks the sums are cut again and meet those of
   other groups, and so on, until one list per range is global. Answers go back down the same tree, in the order of each list;
3. each block builds states, arcs and failure arcs from its counts, and its texts traverse them, `part_tokens` tokens of texts at a time:
   an automaton takes many times the memory of its texts.
An n-gram is in a list at most once, so frequent ones make no hot group. Each block takes part in `fan` rows a level of the tree,
which has log(blocks) / log(fan) levels; a group's memory follows the block size alone.

Null text: empty, only the end token is scored. Repeated rows count and are scored each. Empty table: no rows. No training rows:
every token is unknown.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, keep, split_words

#: Hashes of the begin and end tokens; no word holds a space.
BEGIN, FINAL = (np.uint64(xxhash.xxh64_intdigest(s, 42)) for s in (" begin", " end"))
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mixed(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from the hash of its context and of its last token."""
    x = history * MIX[0] + token
    x ^= x >> np.uint64(29)
    x *= MIX[1]
    return x ^ (x >> np.uint64(32))


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its words and the end token, as hashes in a row; and the number of tokens of each text."""
    starts, words = split_words(texts)
    coded = words.dictionary_encode()
    table = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    lengths = np.diff(starts) + 1
    out = np.empty(int(lengths.sum()), np.uint64)
    ends = np.cumsum(lengths) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[ends] = FINAL
    out[inner] = table[coded.indices.to_numpy()] if len(words) else table[:0]
    return out, lengths


def gram_levels(tokens: np.ndarray, lengths: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Level j, entry i: hash of the n-gram of up to j + 1 tokens that ends at token i; contexts stop at the begin token."""
    first = np.zeros(len(tokens), bool)
    first[np.cumsum(lengths) - lengths] = True
    level = tokens
    yield level
    for _ in range(order - 1):
        before = np.concatenate([[BEGIN], level[:-1]])
        before[first] = BEGIN
        level = mixed(before, tokens)
        del before
        yield level


def gram_hashes(tokens: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """All levels of gram_levels."""
    return list(gram_levels(tokens, lengths, order))


@dataclass
class Grams:
    """The distinct n-grams of one level in a block: a place of each, and the one at each token; then the training counts."""

    where: np.ndarray
    at: np.ndarray
    counts: np.ndarray


class Automaton:
    """The part of the backoff automaton that a block's texts can reach. State 0 is the root; costs are log10 probabilities.

    levels[j] are the n-grams of j + 1 tokens. A context of j tokens is the n-gram of level j - 1 before a token (or the begin of
    a text). Contexts that training has not seen are no states: they stand for the state that their failure arc would lead to.
    """

    def __init__(self, lengths: np.ndarray, levels: list[Grams], texts: int, total: int, types: int, add: float, prior: float):
        n, self.order = len(levels[0].at), len(levels)
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[np.cumsum(lengths) - lengths] = last[np.cumsum(lengths) - 1] = True
        self.word, self.n_words = levels[0].at, len(levels[0].where)
        p = (levels[0].counts + add) / (total + add * (types + 1))
        self.root_cost = np.log10(p)

        # state[j]: the state of the context of j tokens that ends with n-gram k of level j - 1; the last number is the text's begin.
        state, self.fail, self.fail_cost = [None], [np.zeros(1, np.int64)], [np.zeros(1)]
        count = 1
        for j in range(1, self.order):
            below = levels[j - 1]
            seen = np.append(np.where(last[below.where], 0, below.counts), texts)  # nothing follows an end token
            shorter = np.zeros(len(seen), np.int64)
            if j > 1:  # the same tokens but for the first: the context of j - 1 tokens that ends at the same place
                shorter = np.append(state[j - 1][levels[j - 2].at[below.where]], state[j - 1][-1])
            real = seen > 0
            own = np.where(real, count + np.cumsum(real) - 1, shorter)
            self.fail.append(shorter[real])
            self.fail_cost.append(np.log10(prior / (seen[real] + prior)))
            count += int(real.sum())
            state.append(own)
        self.fail, self.fail_cost = np.concatenate(self.fail), np.concatenate(self.fail_cost)
        self.begin = int(state[-1][-1]) if self.order > 1 else 0
        self.after_word = state[1][:-1] if self.order > 1 else np.zeros(self.n_words, np.int64)

        keys, costs, targets = [], [], []
        for j in range(1, self.order):
            g, below = levels[j], levels[j - 1]
            before = np.where(first[g.where], len(below.where), below.at[g.where - 1])  # the context, as a number of state[j]
            context = np.append(below.counts, texts)[before]
            p = (g.counts + prior * p[below.at[g.where]]) / (context + prior)
            some = np.flatnonzero(g.counts)
            keys.append(state[j][before[some]] * self.n_words + self.word[g.where[some]])
            costs.append(np.log10(p[some]))
            targets.append(state[j + 1][some] if j + 1 < self.order else state[j][below.at[g.where[some]]])
        key = np.concatenate([*keys, np.zeros(0, np.int64)])
        by = np.argsort(key, kind="stable")
        self.arc, self.cost, self.target = key[by], np.concatenate([*costs, np.zeros(0)])[by], np.concatenate([*targets, np.zeros(0, np.int64)])[by]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading one token each, and the costs: failure arcs are followed until the token has an arc."""
        cost, after = np.zeros(len(state)), np.empty(len(state), np.int64)
        left, state = np.arange(len(state)), state
        for _ in range(self.order - 1):
            key = state * self.n_words + word[left]
            k = np.searchsorted(self.arc, key)
            hit = (k < len(self.arc)) & (state > 0)
            hit[hit] = self.arc[k[hit]] == key[hit]
            cost[left[hit]] += self.cost[k[hit]]
            after[left[hit]] = self.target[k[hit]]
            left, state = left[~hit], state[~hit]
            cost[left] += self.fail_cost[state]
            state = self.fail[state]
        cost[left] += self.root_cost[word[left]]
        after[left] = self.after_word[word[left]]
        return after, cost

    def traverse(self, lengths: np.ndarray, run: int = 4096) -> np.ndarray:
        """log10 probability of each text, read from left to right in pieces of at most `run` tokens."""
        starts = np.cumsum(lengths) - lengths
        pieces = -(-lengths // run)
        of = np.repeat(np.arange(len(lengths)), pieces)
        offset = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * run
        size = np.minimum(run, lengths[of] - offset)
        warm = np.minimum(self.order - 1, offset)
        by = np.argsort(-(size + warm), kind="stable")
        place, warm, steps = (starts[of] + offset - warm)[by], warm[by], (size + warm)[by]
        state = np.where((offset[by] - warm) == 0, self.begin, 0)
        cost = np.zeros(len(by))
        alive = np.searchsorted(-steps, -np.arange(1, (steps[0] if len(steps) else 0) + 1), side="right")
        for t, n in enumerate(alive):
            state[:n], c = self.step(state[:n], self.word[place[:n] + t])
            cost[:n] += np.where(warm[:n] > t, 0.0, c)
        return np.bincount(of[by], cost, len(lengths))


def distinct(grams: np.ndarray) -> np.ndarray:
    """Sorted distinct values, with one copy of the array beside them."""
    grams = np.sort(grams)
    first = np.ones(len(grams), bool)
    first[1:] = grams[1:] != grams[:-1]
    return grams[first]


def counted_keys(grams: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and how often each stands where train is true."""
    learned = np.sort(grams[train])
    starts = np.flatnonzero(np.append(True, learned[1:] != learned[:-1])[: len(learned)])
    values, many = learned[starts], np.diff(starts, append=len(learned))
    del learned
    keys = distinct(grams)
    counts = np.zeros(len(keys), np.int64)
    counts[np.searchsorted(keys, values)] = many
    return keys, counts


def token_parts(tokens: np.ndarray, lengths: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts in order, cut into parts of about `most` tokens; a longer text is a part of its own."""
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield tokens[before : ends[end - 1]], lengths[start:end]
        start = end


def block_keys(tokens: np.ndarray, lengths: np.ndarray, level: int, most: int, train: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-grams of a level, and how often each stands in texts where train is true: `most` tokens' n-grams at a time are put into the
    list, so beside the tokens and the list memory follows a part."""
    keys, counts, done = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for part, sizes in token_parts(tokens, lengths, most):
        for grams in gram_levels(part, sizes, level + 1):
            pass
        if train is None:
            own, many = distinct(grams), None
        else:
            own, many = counted_keys(grams, np.repeat(train[done : done + len(sizes)], sizes))
        done += len(sizes)
        at = np.searchsorted(keys, own)
        old = at < len(keys)
        old[old] = keys[at[old]] == own[old]
        if train is not None:
            counts[at[old]] += many[old]
            counts = np.insert(counts, at[~old], many[~old])
        keys = np.insert(keys, at[~old], own[~old])
    return keys, counts


def scored_part(
    tokens: np.ndarray, lengths: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], texts: int, total: int, types: int, add: float, prior: float, run: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n_known, base_score and score of some texts of a block, by the automaton that these texts can reach; lists: the block's n-grams by level, with counts."""
    levels = []
    for grams, (keys, counts) in zip(gram_hashes(tokens, lengths, len(lists)), lists, strict=True):
        own, where, at = np.unique(grams, return_index=True, return_inverse=True)
        levels.append(Grams(where, at, counts[np.searchsorted(keys, own)].astype(np.float64)))
    machine = Automaton(lengths, levels, texts, total, types, add, prior)
    first = np.cumsum(lengths) - lengths
    known = np.add.reduceat((levels[0].counts > 0).astype(np.int64)[machine.word], first)
    return known, np.add.reduceat(machine.root_cost[machine.word], first), machine.traverse(lengths, run)


def planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers by byte planes: the upper planes of small numbers are zero and compress away."""
    return numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


REQUEST = "level int, span long, piece long, sender long, keys binary, counts binary"
ANSWER = "level int, piece long, sender long, counts binary, types long, tokens long, texts long"


def each_request(level: int, span: int, sender: int, keys: np.ndarray, counts: np.ndarray, pieces: int) -> Iterator[tuple]:
    """Rows (level, span, piece, sender, keys, counts): the list cut where equal hash ranges, `pieces` in all, begin."""
    low, high = int(keys[0]) * pieces >> 64, int(keys[-1]) * pieces >> 64
    cuts = np.array([-(-(k << 64) // pieces) for k in range(low + 1, high + 1)], np.uint64)
    ends = np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])
    spans = enumerate(zip(ends, ends[1:], strict=False), low)
    return ((level, span, k, sender, packed(keys[x:y]), planes(counts[x:y])) for k, (x, y) in spans if y > x)


def requests(level: int, span: int, sender: int, keys: np.ndarray, counts: np.ndarray, pieces: int) -> list[tuple]:
    return list(each_request(level, span, sender, keys, counts, pieces))


def merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The lists of a group by sender, their distinct keys, and the key that each entry of the lists is, in a row."""
    lists = [unpacked(x.as_py()) for x in table["keys"]]
    keys, at = np.unique(np.concatenate(lists), return_inverse=True)
    return lists, keys, at


def sums_of(table: pa.Table, at: np.ndarray, n: int) -> np.ndarray:
    counts = np.concatenate([from_planes(x.as_py()) for x in table["counts"]])
    return np.bincount(at, counts, n).astype(np.int64)  # exact below 2^53


def answers_to(table: pa.Table, lists: list[np.ndarray], at: np.ndarray, total: np.ndarray, sums: tuple[int, int, int]) -> pa.Table:
    """One row per sender, with the totals of its list; the group's sums stand in the first."""
    ends = np.cumsum([len(x) for x in lists])
    counts = [planes(total[at[e - len(x) : e]]) for x, e in zip(lists, ends, strict=True)]
    first = np.arange(len(lists)) == 0
    return pa.table([table["level"], table["piece"], table["sender"], pa.array(counts, pa.binary()), *[pa.array(np.where(first, x, 0), pa.int64()) for x in sums]], names=["level", "piece", "sender", "counts", "types", "tokens", "texts"])


def as_table(rows: list[tuple]) -> pa.Table:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["level", "span", "piece", "sender", "keys", "counts"])


def summed_answers(asked: DataFrame, blocks: int, fan: int) -> DataFrame:
    """asked: the blocks' requests (span: block // fan). Answers in the form of ANSWER; `sender` is a block, `piece` its range."""
    depth = 1
    while fan**depth < blocks:
        depth += 1

    def top(table: pa.Table) -> pa.Table:
        lists, keys, at = merged(table)
        total = sums_of(table, at, len(keys))
        words = table["level"][0].as_py() == 0
        k = int(np.searchsorted(keys, FINAL))
        texts = int(total[k]) if words and k < len(keys) and keys[k] == FINAL else 0
        return answers_to(table, lists, at, total, (int((total > 0).sum()), int(total.sum()), texts))

    def pass_on(pieces: int):
        def run(table: pa.Table) -> pa.Table:
            _, keys, at = merged(table)
            level, span, piece = (table[c][0].as_py() for c in ("level", "span", "piece"))
            # The group is named by its span and piece; it is one sender in the group of the next level.
            return as_table(requests(level, span // fan, span * (pieces // fan) + piece, keys, sums_of(table, at, len(keys)), pieces))

        return run

    def pass_back(table: pa.Table, given: pa.Table) -> pa.Table:
        lists, keys, at = merged(table)
        given = given.sort_by("piece")
        total = np.concatenate([from_planes(x.as_py()) for x in given["counts"]])
        sums = tuple(int(np.sum(given[c].to_numpy())) for c in ("types", "tokens", "texts"))
        return answers_to(table, lists, at, total, sums)

    levels, group = [asked], ["level", "span", "piece"]
    for k in range(1, depth):
        levels[-1] = keep(levels[-1])  # read again when the answers come back
        levels.append(levels[-1].groupBy(*group).applyInArrow(pass_on(fan ** (k + 1)), REQUEST))
    answers = levels[-1].groupBy(*group).applyInArrow(top, ANSWER)
    for k in range(depth - 1, 0, -1):
        named = levels[k - 1].withColumn("group", F.col("span") * fan**k + F.col("piece"))
        back = answers.withColumnRenamed("sender", "group")
        answers = named.groupBy("level", "group").cogroup(back.groupBy("level", "group")).applyInArrow(pass_back, ANSWER)
    return keep(answers)


def block_requests(batches: Iterator[pa.RecordBatch], order: int, fan: int, most: int) -> Iterator[pa.RecordBatch]:
    """A block's requests, level by level; of its texts only the tokens are held."""
    parts, block = [], 0
    for batch in batches:
        block = batch["block"][0].as_py() if batch.num_rows else block
        for part in by_bytes(batch, "text"):
            parts.append((*token_hashes(part["text"]), ~part["held_out"].to_numpy(zero_copy_only=False)))
        batch = part = None
    tokens, lengths, train = (np.concatenate([p[i] for p in parts]) for i in range(3))
    parts.clear()
    for level in range(order):
        for row in each_request(level, block // fan, block, *block_keys(tokens, lengths, level, most, train), fan):
            yield from as_table([row]).to_batches()


def block_scores(
    batches: Iterator[pa.RecordBatch], texts: int, total: int, types: int, order: int, add: float, prior: float, run: int, most: int
) -> Iterator[pa.RecordBatch]:
    """The scores of a block's texts, from rows of texts and rows of answers (level not null) in any order; of the texts only the tokens are held."""
    tokens, lengths, rows, answers = [], [], [], []
    for batch in batches:
        for part in by_bytes(batch, "text"):
            answer = pc.is_valid(part["level"])
            given, own = part.filter(answer), part.filter(pc.invert(answer))  # copies, so the batch is held no longer
            answers.extend(zip(*[given[c].to_pylist() for c in ("level", "piece", "counts")], strict=True))
            if own.num_rows:
                found, many = token_hashes(own["text"])
                tokens.append(found)
                lengths.append(many)
                rows.append(own.select(["id", "held_out"]))
        batch = part = given = own = None
    tokens, lengths, rows = np.concatenate(tokens), np.concatenate(lengths), pa.Table.from_batches(rows)
    lists, answers = [], sorted(answers)
    for level in range(order):
        keys, _ = block_keys(tokens, lengths, level, most)
        counts = np.concatenate([from_planes(data) for j, _, data in answers if j == level])
        answers = [a for a in answers if a[0] > level]
        lists.append((keys, counts))
    parts = [scored_part(t, n, lists, texts, total, types, add, prior, run) for t, n in token_parts(tokens, lengths, most)]
    del lists, tokens
    made = [rows["id"], rows["held_out"], pa.array(lengths), *[pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]]
    yield from pa.table(made, names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"]).to_batches()


def lm_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: Column | None = None,
    order: int = 2,
    add: float = 0.1,
    prior: float = 200.0,
    block_chars: int = 1 << 24,
    fan: int = 512,
    run: int = 4096,
    part_tokens: int = 1 << 18,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; rows with held_out true are not learned from."""
    held_out = F.lit(False) if held_out is None else held_out
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text.alias("text"))
    chars = rows.agg(F.sum(F.length("text") + F.lit(16))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    fan = max(2, min(fan, blocks))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return block_requests(batches, order, fan, part_tokens)

    answers = summed_answers(rows.groupBy("block").applyInArrow(ask, REQUEST), blocks, fan).withColumnRenamed("sender", "block")
    sums = answers.where("level = 0").agg(F.sum("types"), F.sum("tokens"), F.sum("texts")).first()
    types, total, texts = (int(x or 0) for x in sums)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return block_scores(batches, texts, total, types, order, add, prior, run, part_tokens)

    # Texts and answers of a block come as one group, read batch by batch; a cogroup would hold both as whole tables.
    none = lambda kind: F.lit(None).cast(kind)
    read = rows.select("block", "id", "held_out", "text", *[none(kind).alias(c) for c, kind in (("level", "int"), ("piece", "long"), ("counts", "binary"))])
    asked = answers.select("block", none("long").alias("id"), none("boolean").alias("held_out"), none("string").alias("text"), "level", "piece", "counts")
    scored = read.union(asked).groupBy("block").applyInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out=held).withColumnRenamed("id", "doc_id")
