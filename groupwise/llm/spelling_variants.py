"""Spelling variants: words one edit apart, found by pivotal grams, and each rare word's more frequent form.

Bigrams are ordered from rare to frequent. A word's prefix is its three rarest bigrams (ties of the third included): one edit touches two
bigrams at most. In the prefix, dynamic programming over the positions picks two pivots, disjoint bigrams of least total frequency.
One edit leaves at least one of two disjoint pivots whole: it lies behind the left pivot, so that all up to that pivot is unchanged, or before
the right one, so that all from that pivot on is. Of two near words take the one whose prefix ends with the rarer bigram: its
whole pivot is in the other's prefix too. So pivots are joined with the bigrams of the prefixes, and a bigram meets a pivot only
at the same distance from the unchanged end (positions differ by the edit at most) and with that end equal; lengths differ by one at
most. What meets is verified by edit distance inside the join; no pair of near words is missed.

The join's size follows the vocabulary (words that occur often enough), not the texts: words are counted before any shuffle. Joins are
sort-merge joins, whose hot keys Spark splits at run time.

Null texts have no words; a null doc_id counts as an empty string; repeated rows count as often as they stand there. Empty table: no rows.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, keep

#: Fixed value: runs of letters of Latin-1 (its two signs among them included).
RUN = r"[A-Za-zÀ-ÿ]+"
#: Bigrams that one edit can touch, plus one.
PREFIX = 3


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case; words of ASCII alone take the faster way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def misspelt(word: Column, id_: Column, divisor: int) -> Column:
    """The word without one code point where the crc32 of id and word is divisible by `divisor`."""
    h = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % divisor == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, id_col: str, text_col: str, divisor: int = 199, shortest: int = 6, fewest: int = 5) -> DataFrame:
    """(word, n): the runs of all whole texts after the deletions, at least `shortest` code points long and `fewest` times there."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select("id", lower_ascii(F.col("run")).alias("run")).select(misspelt(F.col("run"), F.col("id"), divisor).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def pivots(word: str, order: Mapping[str, tuple[int, int]]) -> tuple[int, int, int, list[int]]:
    """(rank of the prefix's last bigram, left pivot, right pivot, places of the prefix's bigrams); order: bigram to (rank, frequency)."""
    grams = [order[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(rank for rank, _ in grams)[PREFIX - 1]
    places = [i for i, (rank, _) in enumerate(grams) if rank <= last]
    cheapest: list[tuple[int, int]] = []  # over the places so far: the least frequency of a left pivot, and its place
    best = None
    for at, j in enumerate(places):
        free = at - 1  # the last place that ends before j begins
        while free >= 0 and places[free] > j - 2:
            free -= 1
        if free >= 0:
            cost, i = cheapest[free]
            if best is None or cost + grams[j][1] < best[0]:
                best = (cost + grams[j][1], i, j)
        here = (grams[j][1], j)
        cheapest.append(min(here, cheapest[-1]) if cheapest else here)
    return last, best[1], best[2], places


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of every two words (word, n; each once) that differ by exactly one inserted, deleted or replaced code point.

    Words have four code points at least; shorter ones have no two disjoint bigrams to choose from and raise an error. The table of bigrams is
    held by the driver and each task: as many rows as the alphabet has pairs of letters, 8,100 for `RUN` (90 letters)."""
    at = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(at, lambda i: F.substring("word", i, F.lit(2)))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    order = {r.gram: (rank, r.n) for rank, r in enumerate(sorted(grams.collect(), key=lambda r: (r.n, r.gram)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for word in batch["word"].to_pylist():
                if len(word) < PREFIX + 1:
                    raise ValueError(f"a word of {len(word)} code points has no two disjoint pivots")
                found.append(pivots(word, order))
            last, left, right, places = zip(*found, strict=True) if found else ((), (), (), ())
            arrays = [pa.array(last, pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], *arrays], names=["word", "n", "last", "left", "right", "places"])

    cut = keep(words.select("word", F.col("n").cast("long")).mapInArrow(run, "word string, n long, last int, left int, right int, places array<int>"))
    up_to = lambda i: F.substring("word", F.lit(1), i + 2)
    from_ = lambda i: F.substring("word", i + 1, F.length("word"))
    key = lambda side, text: F.struct(F.lit(side).alias("side"), text.alias("same"))
    lengths = F.explode(F.sequence(F.length("word") - 1, F.length("word") + 1)).alias("length")
    indexed = cut.select("word", "n", "last", F.inline(F.array(key(0, up_to(F.col("left"))), key(1, from_(F.col("right")))))).select("*", lengths)
    both = F.concat(F.transform("places", lambda i: key(0, up_to(i))), F.transform("places", lambda i: key(1, from_(i))))
    prefixes = cut.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("last").alias("near_last"), F.length("word").alias("length"), F.inline(both))
    met = indexed.join(prefixes.hint("shuffle_merge"), ["side", "same", "length"])
    found = met.where((F.col("last") <= F.col("near_last")) & (F.levenshtein("word", "near", 1) == 1))
    ways = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return found.select(F.inline(ways)).distinct()


def spelling_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word (word, n).

    form: the near word of largest n (ties: the smallest in code-point order) if that is at least `times` the word's, times >= 2; root: the last
    form of the chain of forms, the word itself if it has none. n grows along a chain by `times`, so a chain has at most log(largest n) links;
    each round of pointer jumping halves what is left of it."""
    words = keep(words)
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    joined = words.join(near.hint("shuffle_merge"), "word", "left")
    enough = -F.col("top.less") >= times * F.col("n")
    table = keep(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("top.near")).alias("form"), F.when(enough, -F.col("top.less")).alias("form_n")))
    links = table.where("form is not null").select("word", F.col("form").alias("root"))
    longest = math.log(max(2, words.agg(F.max("n")).first()[0] or 2), times) + 1
    for _ in range(math.ceil(math.log2(longest + 1))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = keep(links.join(onward.hint("shuffle_merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return table.join(links.hint("shuffle_merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
