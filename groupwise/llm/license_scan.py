"""License scans by a positional rare-token index, in DataFrame functions only.

Templates (license notices and bare phrases) are posted by word and position. The words of all templates are weighed by inverse
document frequency over the whole corpus. A template's anchors are its rarest words: the fewest, by falling weight, without which
the other words could not reach the needed share of its weight, so a file that holds none of them cannot hold the template. In each file the anchors' places are
looked up; place minus posted position is where the template would start, and starts on which postings agree are compared word by
word. A template counts where the matched weight reaches `share` and its mandatory phrase stands at its place.

Phrases are templates that must match wholly, so their anchor finds every place. All work is inside the row: no shuffle but the
document frequencies of the template words.

Null or empty text: no words, score 0, no labels. Repeated rows are scanned alike. Empty table: no rows. Other columns of the input
stay; earlier columns named n_words, places, notices or score are replaced. The templates are part of the plan, which suits some
dozens of notices; a list of many hundreds would need a table of postings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower

#: Bare phrases and their labels; and notices with their mandatory phrase and label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = [
    ("released under the mit license", "mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted", "mit"),
    ("licensed under the apache license version 2 0", "apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc by 4 0", "cc-by-4.0"),
    ("all rights reserved", "all rights reserved", "all-rights-reserved"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "without warranty of any kind express or implied", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted", "isc"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products derived from this software", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain", "unlicense"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance", "apache-2.0"),
]
#: Starts are coded as template * STRIDE + BEFORE + start, so that distinct hashes longs; a notice cut off by the text's begin starts below 0.
STRIDE, BEFORE = 1 << 40, 1 << 10


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def idf(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of the template words over all documents: as many numbers as there are such words."""
    seen = F.array_intersect(words(F.lower(F.col(text_col))), F.array(*map(F.lit, vocabulary)))
    row = docs.select(F.explode(F.concat(seen, F.array(F.lit("")))).alias("w")).groupBy("w").count()
    df = {r.w: r["count"] for r in row.collect()}  # at most one row a template word, and the number of documents at ""
    n = df.get("", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in vocabulary}


def anchors(template: list[str], weight: dict[str, float], share: float) -> list[str]:
    """The rarest words, until what is left weighs less than the share that a match needs: every match holds at least one of them."""
    total, chosen = sum(weight[w] for w in template), []
    for w in sorted(set(template), key=lambda w: (-weight[w], w)):
        chosen.append(w)
        if sum(weight[x] for x in template if x not in chosen) < share * total:
            return chosen
    return chosen


def scan(docs: DataFrame, text_col: str = "text", phrases: dict[str, str] | None = None, notices: list[tuple[str, str, str]] | None = None, share: float = 0.7) -> DataFrame:
    """docs with n_words, places (label, start; of phrases), notices (label, start, score) and score (the best notice or phrase, 0 to 1)."""
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    templates = [(p.split(), p.split(), label, True) for p, label in phrases.items()] + [(t.split(), key.split(), label, False) for t, key, label in notices]
    vocabulary = sorted({w for t, *_ in templates for w in t})
    weight = idf(docs, text_col, vocabulary)
    rare: dict[str, list[int]] = {}
    for k, (template, _, _, whole) in enumerate(templates):
        for a in anchors(template, weight, 1.0 if whole else share):
            rare.setdefault(a, []).extend(k * STRIDE + BEFORE - at for at, w in enumerate(template) if w == a)
    postings = F.create_map(*[x for w, ps in rare.items() for x in (F.lit(w), F.array(*map(F.lit, ps)))])
    texts = F.array(*[F.array(*map(F.lit, t)) for t, *_ in templates])
    weights = F.array(*[F.array(*[F.lit(weight[w]) for w in t]) for t, *_ in templates])
    key_at = F.array(*[F.lit(next((i for i in range(len(t)) if t[i : i + len(key)] == key), 0)) for t, key, *_ in templates])
    key_len = F.array(*[F.lit(len(key)) for _, key, *_ in templates])
    labels = F.array(*[F.lit(label) for _, _, label, _ in templates])

    # lower() only finds candidates; words are compared with A-Z lower-cased. Documents without any anchor keep an empty array.
    low = F.lower(F.col(text_col))
    any_anchor = F.lit(False)
    for a in sorted(rare):
        any_anchor = any_anchor | F.contains(low, F.lit(a))
    inner = {}  # names of columns that no input column has
    for name in ("words", "some", "hits", "starts", "found"):
        inner[name] = "_" + name
        while inner[name] in docs.columns:
            inner[name] = "_" + inner[name]
    held = docs.withColumns({inner["words"]: words(F.col(text_col)), inner["some"]: F.coalesce(any_anchor, F.lit(False))}).withColumn("n_words", F.size(inner["words"]).cast("long"))
    held = held.withColumn(inner["words"], F.when(F.col(inner["some"]), F.transform(inner["words"], ascii_lower)).otherwise(F.array().cast("array<string>")))
    held = held.withColumn(inner["hits"], F.filter(F.transform(inner["words"], lambda w, i: F.when(w.isin(list(rare)), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull()))
    starts = F.array_sort(F.array_distinct(F.flatten(F.transform(inner["hits"], lambda h: F.transform(F.element_at(postings, h["w"]), lambda p: p + h["i"])))))
    start = lambda c: F.pmod(c, F.lit(STRIDE)) - BEFORE
    held = held.withColumn(inner["starts"], starts)

    def compared(c: Column) -> Column:
        k, s = (c / STRIDE).cast("int"), start(c).cast("int")
        same = F.transform(F.get(texts, k), lambda w, j: F.coalesce(F.get(inner["words"], s + j) == w, F.lit(False)))
        got = F.aggregate(F.zip_with(same, F.get(weights, k), lambda m, x: F.when(m, x).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
        full = F.aggregate(F.get(weights, k), F.lit(0.0), lambda a, b: a + b)
        phrase = F.forall(F.slice(same, F.get(key_at, k) + 1, F.get(key_len, k)), lambda m: m)
        return F.struct(k.alias("template"), F.get(labels, k).alias("label"), s.cast("long").alias("start"), F.when(phrase, F.least(F.lit(1.0), got / full)).otherwise(0.0).alias("score"))

    found = held.withColumn(inner["found"], F.filter(F.transform(inner["starts"], compared), lambda m: m["score"] >= F.when(m["template"] < len(phrases), 1.0 - 1e-9).otherwise(share)))
    pick = lambda phrase: F.filter(inner["found"], lambda m: (m["template"] < len(phrases)) == F.lit(phrase))
    return found.withColumns({
        "places": F.transform(pick(True), lambda m: F.struct(m["label"].alias("label"), m["start"].alias("start"))),
        "notices": F.transform(pick(False), lambda m: F.struct(m["label"].alias("label"), m["start"].alias("start"), m["score"].alias("score"))),
        "score": F.coalesce(F.array_max(F.transform(inner["found"], lambda m: m["score"])), F.lit(0.0)),
    }).drop(*inner.values())


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    at = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("notices", lambda m: m["label"]))).alias("labels"), F.round("score", 6).alias("score"),
    )
