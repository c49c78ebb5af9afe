"""The pipeline's near-copy stage against planted copies and a brute-force version."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from groupwise.llm import near_copies as near_copies_module
from groupwise.llm.near_copies import near_copies, shingle_sets


def plain_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def plain_groups(texts, least=0.8):
    sets, root = [plain_sets(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if not both or len(sets[i] & sets[j]) / both >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def planted():
    """Texts of 120 to 300 words and, of each, copies with single words replaced; similarities from 0.6 to 1."""
    rng = random.Random(3)
    texts = []
    for k in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(120, 300))]
        texts.append(" ".join(base))
        for n in (0, 1, 2, 3, 4, 6, 8):
            copy = list(base)
            for i in rng.sample(range(len(copy)), n):
                copy[i] = f"new{k}x{n}x{i}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return [*texts, "one two", "One  two", "one two three", "", None, "  "]


def test_sets_have_the_right_sizes():
    texts = ["a b c d e f", "A b c", None, "", "x x x x x x x x", "a b c"]
    starts, sets = shingle_sets(pa.array(texts), 5)
    assert np.diff(starts).tolist() == [len(plain_sets(t)) for t in texts]
    assert sets[starts[1]] == sets[starts[5]]


def test_stage_keeps_one_of_each_group_of_planted_copies(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(plain_groups(texts))
    parts = {}
    for r in near_copies(docs).collect():
        parts.setdefault(r.component, set()).add(r.id)
    expected = {}
    for i, g in enumerate(plain_groups(texts)):
        expected.setdefault(g, set()).add(i)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, expected.values()))


def test_a_common_passage_in_many_texts(spark):
    """Crowded cells are joined by prefixes; the groups stay those of brute force."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for k in range(220):
        own = [f"w{rng.randrange(9000)}" for _ in range(45)]
        texts.append(" ".join(own[:20] + passage + own[20:]))
        if k % 11 == 0:
            texts.append(texts[-1] + " tail")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = plain_groups(texts)
    for dense in (4, 10**6):
        parts = {}
        for r in near_copies(docs, dense=dense).collect():
            parts.setdefault(r.component, set()).add(r.id)
        assert sorted(map(sorted, parts.values())) == sorted([i for i, g in enumerate(expected) if g == root] for root in set(expected))


def test_pairs_at_the_bound_in_crowded_cells(spark):
    """Texts of 130 words that share a passage of 90; each pair differs in its last 14 words, 112 of 140 five-word runs in common: exactly 0.8."""
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(90)]
    for pairs, dense in ((60, 4), (240, 16)):
        texts = []
        for _ in range(pairs):
            own = [f"w{rng.randrange(10**6)}" for _ in range(40)]
            texts += [" ".join(passage + own), " ".join(passage + own[:26] + [f"v{rng.randrange(10**6)}" for _ in range(14)])]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        component = {r.id: r.component for r in near_copies(docs, dense=dense, broadcast_rows=0 if dense == 4 else 10**6).collect()}
        assert sum(component[2 * k] == component[2 * k + 1] for k in range(pairs)) >= 0.99 * pairs
        assert len(set(component.values())) >= pairs


def test_sets_are_made_only_for_texts_in_pairs(spark, monkeypatch):
    """Two copies with one word changed among 300 unrelated texts: no table holds the sets of the others, which all share cells by chance."""
    rng, rows = random.Random(5), []
    for i in range(300):
        rows.append((i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))))
    rows.append((300, rows[7][1].replace(rows[7][1].split()[0], "other")))
    made = []

    def keep(df):
        out = near_copies_module.stored(df)
        if "s" in out.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(near_copies_module, "stored", near_copies_module.keep, raising=False)
    monkeypatch.setattr(near_copies_module, "keep", keep)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    component = {r.id: r.component for r in near_copies(docs).collect()}
    assert component[7] == component[300] and len(set(component.values())) == 300
    assert sum(made) < 100
