"""Scores against a plain version on dictionaries; labels given twice; copies."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from groupwise.llm.common import keep
from groupwise.llm.toxicity import features, learn, logistic, score_texts, solve_lambda, training_rows
from tests.llm.test_toxicity import plain_segments

STEMS, PRIOR, Z, ODDS, DRIFT, SURE = (6, 5, 4), 100.0, 4.0, 1.5, 0.25, 0.05


def corpus():
    rng = random.Random(4)
    nice, foul = [f"word{chr(97 + i)}" for i in range(20)], ["idiot", "scum", "moronic", "moronix"]
    out = []
    for k in range(400):
        words = [rng.choice(nice) for _ in range(rng.randrange(8, 30))]
        label = int(k % 4 == 0)
        if label and k % 20:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(foul) for _ in range(rng.randrange(2, 5))]
        out.append((" ".join(words), label))
    return out + out[:30] * 3


def plain_scores(rows):
    """rows: (text, label, weight)."""
    words = [re.findall(r"[^\W_]+", t.lower()) for t, *_ in rows]
    of = {w: features(w, STEMS) for ws in words for w in ws}
    seen = (Counter(), Counter())
    total = [0.0, 0.0]
    for ws, (_, label, weight) in zip(words, rows, strict=True):
        total[label] += weight
        for f in {f for w in ws for f in of[w]}:
            seen[label][f] += weight
    kept = {}
    for f in seen[0].keys() | seen[1].keys():
        share = (seen[1][f] + seen[0][f]) / sum(total)
        a, b = seen[1][f] + PRIOR * share, seen[0][f] + PRIOR * share
        odds = math.log(a / max(total[1] + PRIOR - a, 0.5)) - math.log(b / max(total[0] + PRIOR - b, 0.5))
        if abs(odds) >= ODDS and abs(odds) / math.sqrt(1 / a + 1 / b) >= Z:
            kept[f] = odds
    value = {w: next((kept[f] for f in fs if f in kept), 0.0) for w, fs in of.items()}
    hist = Counter()
    for ws, (_, label, weight) in zip(words, rows, strict=True):
        for w in ws if not label else []:
            hist[np.round(value[w] * 16) / 16] += weight
    lam = solve_lambda(np.array([x - DRIFT for x in hist]), np.array(list(hist.values())))
    found = [plain_segments([value[w] - DRIFT for w in ws]) for ws in words]
    clean = [(w, max(len(ws), 1) * math.exp(-lam * max((s for *_, s in segs), default=0.0))) for ws, segs, (_, label, w) in zip(words, found, rows, strict=True) if not label]
    k = min(1.0, sum(w for w, _ in clean) / sum(w * x for w, x in clean))
    expected = lambda s, ws: k * max(len(ws), 1) * math.exp(-lam * s)
    evidence = [sum(-math.log(max(expected(s, ws), 1e-300)) for *_, s in segs if expected(s, ws) < SURE) for ws, segs in zip(words, found, strict=True)]
    bins = Counter((label, min(round(math.log1p(e) * 256), 4095) / 256) for e, (_, label, _) in zip(evidence, rows, strict=True))
    a, b = logistic(np.array([x for _, x in bins]), np.array([y for y, _ in bins], float), np.array(list(bins.values()), float))
    p = [1 / (1 + math.exp(-(a * math.log1p(e) + b))) for e in evidence]
    return [x if e > 0 else min(x, 0.25) for x, e in zip(p, evidence, strict=True)], kept


def test_scores_match_the_plain_version(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    train = keep(training_rows(docs, labels, F.lit(True)))
    given = [(r.text, r.label, r.weight) for r in train.collect()]
    same = Counter(given)
    assert len(given) == len(rows) and sum(w for *_, w in given) < len(rows)  # all rows stay, copies weigh less
    assert all(n * w <= 1 + 1e-9 for (_, _, w), n in same.items())
    for bound in (1_000_000, 0):  # with and without broadcasts
        again = training_rows(docs, labels, F.lit(True), broadcast_rows=bound).collect()
        assert Counter((r.text, r.label, r.weight) for r in again) == same
    model = learn(train)
    expected, kept = plain_scores(given)
    assert model.weight == pytest.approx(kept) and len(kept) >= 4
    got = {r.text: r.score for r in score_texts(train.select("text").distinct(), model).collect()}
    for (text, *_), score in zip(given, expected, strict=True):
        assert got[text] == pytest.approx(score, abs=1e-6)
    assert max(s for (t, y, _), s in zip(given, expected, strict=True) if "scum" in t) > 0.5


def test_the_greatest_of_several_labels_counts(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (2, "d e f"), (3, "g"), (None, "h")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, None), (2, 0), (2, 0), (3, 7), (None, 1)], "doc_id long, toxic int")
    got = sorted(map(tuple, training_rows(docs, labels, F.lit(True)).collect()))
    assert got == [("a b c", 1, 1.0), ("d e f", 0, 0.5), ("d e f", 0, 0.5)]
