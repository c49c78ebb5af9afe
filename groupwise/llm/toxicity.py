"""Toxicity by maximum-scoring segments over token log-odds.

Learning, from labelled rows only: in how many toxic and clean texts each feature of a token occurs (the token itself and its
first `stems` letters). The log-odds of a feature, with an informative Dirichlet prior in proportion to its overall frequency,
are kept if they exceed `least_z` standard errors and `least_odds`. A token scores its longest kept feature's log-odds less
`drift`; any other token scores -drift. Texts with the same smallest hash of three words share one vote in these counts (each
weighs 1 / their number), so that a group of copies does not vouch for all of its words; no text is left out.

Scoring: one linear scan finds every maximal-scoring segment of a text (each cannot be extended or cut without loss). Their
scores follow an extreme-value law, P(S > x) about K m exp(-lambda x) for m tokens; lambda solves the moment equation of the
token scores of clean training texts, and K is fitted to their best segments. A text's evidence is the sum of -log of the
expected number over its significant segments, and a one-variable logistic fit over all labelled rows, each counting once, turns
evidence into a probability. A text without a significant segment scores at most `QUIET`.

What reaches the driver is the table of kept features (more than `most_features` raise an error: it must fit the tasks) and
histograms of at most 4096 bins. Of several labels for one id the greatest counts. Null or empty text: no tokens, evidence 0.
Repeated rows are scored alike. Empty tables: no rows, or a score of 0.5 without anything learned (no labels, or one class
only); no passages are found then, and the pipeline keeps all documents. Whole texts are scored, in slices of bounded memory.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from .common import by_bytes, join_counted, keep


#: The score of a text without a significant segment is at most this; it lies below the threshold of `toxicity`.
QUIET = 0.25


@dataclass(frozen=True)
class Segment:
    start: int
    end: int
    score: float


def segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[Segment]:
    """All maximal-scoring segments, in one pass; at: places of the tokens with a feature, score: their log-odds; all tokens cost drift.

    A list of candidates is kept, each with the running sum before (low) and after (high) it. A new positive token joins back to the
    last candidate that began as low or lower and ended lower than it, if there is one (of equal sums the leftmost segment counts); each candidate is merged or left behind once.
    """
    out: list[list[float]] = []  # low, high, start, end, index of the nearest earlier candidate with as small a low or a smaller one
    total, past = 0.0, -1
    for place, s in zip(at.tolist(), score.tolist(), strict=True):
        total -= drift * (place - past - 1)
        past = place
        low, total = total, total + s - drift
        if s <= drift:
            continue
        begin, high, k = place, total, len(out) - 1
        while True:
            while k >= 0 and out[k][0] > low:
                k = int(out[k][4])
            if k < 0 or out[k][1] >= high:
                break
            low, begin = out[k][0], int(out[k][2])
            del out[k:]
            k = len(out) - 1
        out.append([low, high, begin, place + 1, k])
    return [Segment(int(b), int(e), high - low) for low, high, b, e, _ in out]


def tokens_of(texts: pa.Array, stems: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Number of tokens of each text; all tokens as codes; and the distinct tokens. Tokens are runs of letters and digits in lower case."""
    flat = pc.utf8_lower(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\t", " "))
    lists = pc.split_pattern_regex(flat, r"[^\p{L}\p{N}]+")
    words, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    there = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])[ends]
    coded = words.filter(there).dictionary_encode()
    return np.diff(kept), coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def features(word: str, stems: tuple[int, ...]) -> list[str]:
    return [word, *(word[:n] + "*" for n in stems if len(word) > n)]


@dataclass
class Model:
    weight: dict[str, float]
    stems: tuple[int, ...]
    drift: float
    lam: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    shift: float = 0.0
    quiet: float = QUIET

    def of_words(self, words: list[str]) -> np.ndarray:
        get = self.weight.get
        return np.array([next((x for x in map(get, features(w, self.stems)) if x is not None), 0.0) for w in words])

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, list[Segment]]]:
        lengths, codes, words = tokens_of(texts, self.stems)
        score = self.of_words(words)[codes] if len(words) else np.zeros(0)
        hit = np.flatnonzero(score)
        ends = np.cumsum(lengths)
        bounds = np.searchsorted(hit, np.concatenate([[0], ends]))
        for d, n in enumerate(lengths):
            mine = hit[bounds[d] : bounds[d + 1]]
            yield int(n), segments(mine - (ends[d] - n), score[mine], self.drift)

    def expected(self, score: float, n: int) -> float:
        """Number of segments of this score or more that a clean text of n tokens would hold."""
        return self.k * max(n, 1) * math.exp(-self.lam * score)

    def evidence(self, n: int, found: list[Segment], significant: float) -> tuple[float, int]:
        sure = [e for e in (self.expected(s.score, n) for s in found) if e < significant]
        return sum((-math.log(max(e, 1e-300)) for e in sure), 0.0), len(sure)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.shift, -40, 40)))
        return np.where(evidence > 0, p, np.minimum(p, self.quiet))


def labelled_counts(rows: DataFrame, stems: tuple[int, ...]) -> DataFrame:
    """(feature, tox, clean): weight of the texts that hold a feature, by label; all texts stand under the feature ''."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                seen = (Counter(), Counter())
                lengths, codes, words = tokens_of(part["text"], stems)
                ends = np.cumsum(lengths)
                of = [features(w, stems) for w in words]
                for d, (label, weight) in enumerate(zip(part["label"].to_pylist(), part["weight"].to_pylist(), strict=True)):
                    mine = np.unique(codes[ends[d] - lengths[d] : ends[d]])
                    of_label = seen[label]
                    for f in {"", *(f for c in mine.tolist() for f in of[c])}:
                        of_label[f] += weight
                names = list(seen[0].keys() | seen[1].keys())
                sums = [pa.array([float(seen[k][f]) for f in names]) for k in (1, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *sums], names=["feature", "tox", "clean"])

    counted = rows.mapInArrow(count, "feature string, tox double, clean double")
    return counted.groupBy("feature").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))


def kept_features(counts: DataFrame, n_tox: float, n_clean: float, prior: float, least_z: float, least_odds: float) -> DataFrame:
    """(feature, odds): log-odds of toxic over clean texts, under a Dirichlet prior of `prior` texts spread like all texts."""
    share = (F.col("tox") + F.col("clean")) / (n_tox + n_clean)
    a, b = F.col("tox") + prior * share, F.col("clean") + prior * share
    rest = lambda n, x: F.greatest(n + prior - x, F.lit(0.5))
    odds = F.log(a / rest(n_tox, a)) - F.log(b / rest(n_clean, b))
    z = odds / F.sqrt(1 / a + 1 / b)
    named = counts.where("feature <> ''").select("feature", odds.alias("odds"), z.alias("z"))
    return named.where((F.abs("z") >= least_z) & (F.abs("odds") >= least_odds)).select("feature", "odds")


def learn(
    rows: DataFrame,
    stems: tuple[int, ...] = (6, 5, 4),
    prior: float = 100.0,
    least_z: float = 4.0,
    least_odds: float = 1.5,
    most_features: int = 1_000_000,
    drift: float = 0.25,
    significant: float = 0.05,
) -> Model:
    """rows: (text, label 0 or 1, weight), a written table. prior: weight of the Dirichlet prior in texts."""
    counts = keep(labelled_counts(rows, stems))
    n = counts.where("feature = ''").first()
    n_tox, n_clean = (n.tox, n.clean) if n else (0.0, 0.0)
    if not n_tox or not n_clean:
        return Model({}, stems, drift, slope=0.0, quiet=0.5)
    top = keep(kept_features(counts, n_tox, n_clean, prior, least_z, least_odds))
    if top.count() > most_features:
        raise ValueError(f"more than {most_features} features are kept; raise least_z or most_features")
    model = Model({r.feature: r.odds for r in top.collect()}, stems, drift)

    # Clean texts: how often each token score occurs, for lambda; then their best segments, for K; then evidence by label.
    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                part = part.filter(pc.equal(part["label"], 0))
                lengths, codes, words = tokens_of(part["text"], stems)
                if len(codes):
                    weight = np.repeat(part["weight"].to_numpy(), lengths)
                    value, at = np.unique(np.round(model.of_words(words)[codes] * 16).astype(np.int64), return_inverse=True)
                    many = np.bincount(at, weight, len(value))
                    yield pa.RecordBatch.from_arrays([pa.array(np.clip(value, -2048, 2047)), pa.array(many)], names=["bin", "n"])

    hist = rows.mapInArrow(background, "bin long, n double").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    model.lam = solve_lambda(np.array([r.bin / 16 - drift for r in hist]), np.array([r.n for r in hist], float))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text: weight and what the fit of K needs."""
        for batch in batches:
            for part in by_bytes(batch, "text"):
                part = part.filter(pc.equal(part["label"], 0))
                found = list(model.scan(part["text"]))
                best = np.array([max((s.score for s in f), default=0.0) for _, f in found])
                size = np.array([max(m, 1) for m, _ in found], float)
                yield pa.RecordBatch.from_arrays([part["weight"], pa.array(size * np.exp(-model.lam * best))], names=["weight", "left"])

    fit = rows.mapInArrow(scanned, "weight double, left double").agg(F.sum("weight"), F.sum(F.col("weight") * F.col("left"))).first()
    model.k = min(1.0, fit[0] / fit[1]) if fit[1] else 1.0

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                e = np.array([model.evidence(m, f, significant)[0] for m, f in model.scan(part["text"])])
                bins = np.minimum(np.round(np.log1p(e) * 256), 4095).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part["label"], pa.array(bins)], names=["label", "bin"])

    bins = rows.mapInArrow(weigh, "label int, bin long").groupBy("label", "bin").count().orderBy("label", "bin").collect()
    columns = [np.array(x, float) for x in zip(*((r.bin / 256, r.label, r["count"]) for r in bins), strict=True)]
    model.slope, model.shift = logistic(*columns)
    return model


def solve_lambda(x: np.ndarray, w: np.ndarray) -> float:
    """The positive root of sum w exp(lambda x) = sum w; 1 if no score is positive or the mean is not negative."""
    if not len(x) or not (w[x > 0].sum() > 0) or (w * x).sum() >= 0:
        return 1.0
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (w * np.exp(np.minimum(mid * x, 700))).sum() < w.sum() else (low, mid)
    return low


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit, by Newton's method; the slope has a small penalty, so separable data stay finite."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([(w * (y - p) * x).sum() - ridge * a, (w * (y - p)).sum()])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + ridge, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-9:
            break
    return a, b


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", significant: float = 0.05) -> DataFrame:
    """docs with score, n_passages and evidence; an earlier column of such a name is replaced."""
    docs = docs.drop("score", "n_passages", "evidence")
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, text_col):
                got = [model.evidence(m, f, significant) for m, f in model.scan(part[text_col])]
                e = np.array([x for x, _ in got])
                made = [pa.array(model.probability(e)), pa.array([n for _, n in got], pa.int64()), pa.array(e)]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), *made], names=[*kept, "score", "n_passages", "evidence"])

    out = StructType(list(docs.schema)).add("score", DoubleType()).add("n_passages", LongType()).add("evidence", DoubleType())
    return docs.mapInArrow(run, out)


def training_rows(docs: DataFrame, labels: DataFrame, use: Column, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(text, label, weight) of the labelled documents that `use` allows; weight: 1 / number of such texts with their label and smallest hash."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
    known = keep(known.where(F.col("label").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("label").alias("label")))
    hint = "broadcast" if known.count() <= broadcast_rows else "shuffle_hash"
    chosen = docs.where(use).select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = F.split(F.lower("text"), r"\s+")
    shingle = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    least = F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0))), shingle))
    rows = chosen.join(known.hint(hint), "id").withColumn("words", words)
    rows = keep(rows.select("text", "label", F.xxhash64("label", least).alias("copies")))  # read twice below
    groups = keep(rows.groupBy("copies").agg(F.count("*").alias("many")))
    shared = groups.where("many > 1")
    if shared.count() <= broadcast_rows:
        weighed = rows.join(F.broadcast(shared), "copies", "left")
    else:
        weighed = join_counted(rows, groups, "copies", "many")
    return weighed.select("text", "label", (1 / F.coalesce("many", F.lit(1))).alias("weight"))


def toxicity(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score, predicted, n_passages and evidence. Learned from labels outside the held-out quarter of ids."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = learn(keep(training_rows(docs, labels, ~held)))
    scored = score_texts(docs, model)
    return scored.withColumns({"held_out": held, "predicted": (F.col("score") >= 0.3).cast("int")})


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = toxicity(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "held_out", "score", "predicted", "n_passages")
