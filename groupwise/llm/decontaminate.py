"""Benchmark decontamination by winnowing, in DataFrame functions only.

Fingerprints: of each run of `window` words, the smallest hash of its k-grams is kept. A run of window words that a document
shares with a benchmark item holds the same k-grams on either side, so both keep the same hash: joining the kept hashes finds
every shared run. Only documents with a common hash go on. There every place of a matching k-gram gives an alignment of document
and item; along each alignment the words are compared, and the hits are extended to whole runs of equal words.

Items with fewer words than a window are one window of their own; for each such length, documents are searched by n-grams of just
that length. So that words are equal without regard to A-Z case, candidates are searched in lower(), which is equal wherever
A-Z-lower-cased words are, and the comparison itself uses A-Z only.

Texts are cut into words once: the number of words and the kept hashes are written with the row's key; only documents with a common
hash are cut again, for their words. Each table of the item side (kept hashes, postings, words) and the list of hit documents is
broadcast only if it is counted to have at most `broadcast_rows` rows (words: as many words). Otherwise the joins shuffle, and a
k-gram's places are dealt over `salts` parts, so a passage that very many documents share goes to no single task.

An alignment is taken up only where it begins: at a place whose k-gram before differs on both sides. So a repetitive document and
item give no row for each pair of places.

Null or empty text: no words, no hit. Items without words never occur. Items are told apart by number, not by id: one with a null id counts
in n_hit and has no name to list, and items of one id are listed once. Repeated rows are found alike. Rows are told apart by hashes of id and text.
Empty tables: no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, ascii_lower, keep


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def grams(hashes: Column, k: int) -> Column:
    """A hash for each run of k word hashes."""
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))


def kept_hashes(g: Column, run: int) -> Column:
    """The distinct minima over all runs of `run` k-grams."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(g) - run), lambda i: F.least(*[F.get(g, i + j) for j in range(run)])))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, broadcast_rows: int = 1_000_000, salts: int = 16) -> DataFrame:
    """Per document (id, n_words, n_hit, n_items, items): hit words lie inside any occurrence of an item's window; items are sorted as strings."""
    if not 1 <= k < window:
        raise ValueError("k is below the window")
    text = F.col("text")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumns({"ka": F.xxhash64("id", "text"), "kb": F.hash("text")})
    item_rows = keep(
        items.select(F.col(item_col).cast("string").alias("name"), words(F.col(item_text)).alias("raw"))
        .where(F.size("raw") > 0)
        .select(F.monotonically_increasing_id().alias("item"), "name", F.transform("raw", ascii_lower).alias("item_words"), F.transform("raw", lambda w: F.xxhash64(F.lower(w))).alias("hashes"))
        .withColumn("length", F.least(F.size("item_words"), F.lit(window)))
        .withColumn("gram", F.least("length", F.when(F.col("length") == window, k).otherwise(F.col("length"))))
    )
    lengths = sorted(r.length for r in item_rows.select("length").distinct().collect())  # at most `window` numbers
    full, short = window in lengths, [n for n in lengths if n < window]
    run = window - k + 1

    kinds = [(k, "kept")] * full + [(n, "all") for n in short]
    hashed = source.select("id", "ka", "kb", F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)).alias("h"))
    none = F.array().cast("array<bigint>")

    def searched_for(n: int, how: str) -> Column:
        found = kept_hashes(F.col(f"g{n}"), run) if how == "kept" else F.array_distinct(f"g{n}")
        return F.when(F.size("h") >= (window if how == "kept" else n), F.transform(found, lambda x: F.struct(F.lit(n).alias("gram"), x.alias("hash"))))

    made = hashed
    for n, how in kinds:
        made = made.withColumn(f"g{n}", F.when(F.size("h") >= (window if how == "kept" else n), grams(F.col("h"), n)).otherwise(none))
    empty = F.array().cast("array<struct<gram:int,hash:bigint>>")
    searched = F.concat(empty, *[F.coalesce(searched_for(*kind), empty) for kind in kinds])
    base = keep(made.select("id", "ka", "kb", F.size("h").cast("long").alias("n_words"), searched.alias("searched")))
    looked = base.select("ka", "kb", F.inline("searched"))
    fits = lambda n: "broadcast" if n <= broadcast_rows else "shuffle_merge"

    of_item = lambda n: item_rows.where(F.col("gram") == n)
    before = lambda g: F.transform(g, lambda x, i: F.struct(x.alias("hash"), F.when(i > 0, F.get(g, i - 1)).alias("prev")))
    postings = item_rows.select("item", F.lit(0).alias("gram"), F.lit(0).alias("item_at"), F.lit(0).cast("long").alias("hash"), F.lit(0).cast("long").alias("prev")).limit(0)
    sought = postings.select("gram", "hash")
    for n, how in kinds:
        placed = of_item(n).where(F.col("length") == (window if how == "kept" else n)).select("item", grams(F.col("hashes"), n).alias("g"))
        listed = placed.select("item", F.lit(n).alias("gram"), F.posexplode(before(F.col("g"))).alias("item_at", "x"))
        postings = postings.unionAll(listed.select("item", "gram", "item_at", "x.hash", "x.prev"))
        sought = sought.unionAll(placed.select(F.lit(n).alias("gram"), F.explode(kept_hashes(F.col("g"), run) if how == "kept" else F.col("g")).alias("hash")))
    sought = keep(sought.distinct())
    hits = keep(looked.join(sought.hint(fits(sought.count())), ["gram", "hash"], "left_semi").groupBy("ka", "kb").agg(F.count("*").alias("n")).select("ka", "kb"))
    # The words of the hit documents only.
    bodies = source.join(hits.hint(fits(hits.count())), ["ka", "kb"], "left_semi").select("ka", "kb", words(text).alias("raw"))
    bodies = bodies.select("ka", "kb", F.transform("raw", ascii_lower).alias("ws"), F.transform("raw", lambda w: F.xxhash64(F.lower(w))).alias("h"))
    bodies = keep(bodies.dropDuplicates(["ka", "kb"]))
    if not kinds:
        return base.select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    places = None
    for n, how in kinds:
        listed = bodies.where(F.size("h") >= n).select("ka", "kb", F.lit(n).alias("gram"), grams(F.col("h"), n).alias("g"))
        at = listed.select("ka", "kb", "gram", F.posexplode(before(F.col("g"))).alias("at", "x")).select("ka", "kb", "gram", "at", F.col("x.hash"), F.col("x.prev").alias("prev_here"))
        places = at if places is None else places.unionAll(at)
    postings = keep(postings)
    how = fits(postings.count())
    if how == "broadcast":
        salted, dealt, keys = postings, places, ["gram", "hash"]
    else:
        salted = postings.withColumn("salt", F.explode(F.array(*[F.lit(x) for x in range(salts)])))
        dealt, keys = places.withColumn("salt", F.pmod(F.xxhash64("ka", "at"), F.lit(salts)).cast("int")), ["gram", "hash", "salt"]
    begins_here = F.coalesce(F.col("prev_here") != F.col("prev"), F.lit(True))
    met = dealt.join(salted.hint(how), keys).where(begins_here)
    aligned = met.select("ka", "kb", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hint = fits(item_rows.agg(F.coalesce(F.sum(F.size("item_words")), F.lit(0))).first()[0])
    # Along an alignment: equal words of document and item, as runs of positions; a run counts from the item's window length on.
    sides = aligned.join(bodies.select("ka", "kb", "ws").hint("shuffle_merge"), ["ka", "kb"]).join(item_rows.select("item", "item_words", "length").hint(hint), "item")
    spots = F.filter(F.sequence(F.lit(0), F.size("item_words") - 1), lambda j: F.coalesce(F.get("item_words", j) == F.get("ws", j + F.col("shift")), F.lit(False)))
    begins = F.filter(F.transform("spots", lambda j, i: F.when((i == 0) | (F.get("spots", i - 1) != j - 1), i)), lambda i: i.isNotNull())
    runs = F.transform("begins", lambda b, i: F.struct((F.get("spots", b) + F.col("shift")).alias("from"), (F.coalesce(F.get("begins", i + 1), F.size("spots")) - b).alias("n")))
    found = sides.select("ka", "kb", "item", "shift", "length", spots.alias("spots")).withColumn("begins", begins).select("ka", "kb", "item", F.explode(F.filter(runs, lambda r: r["n"] >= F.col("length"))).alias("r")).select("ka", "kb", "item", F.col("r.from").alias("start"), (F.col("r.from") + F.col("r.n")).alias("end"))
    found = keep(found)
    past = W.partitionBy("ka", "kb").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    spans = found.groupBy("ka", "kb", "start").agg(F.max("end").alias("end"))
    covered = spans.withColumn("past", F.coalesce(F.max("end").over(past), F.lit(0))).groupBy("ka", "kb").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "past"))).cast("long").alias("n_hit"))
    in_docs = found.select("ka", "kb", "item").distinct().join(item_rows.where("name is not null").select("item", "name").hint(fits(item_rows.count())), "item")
    named = in_docs.select("ka", "kb", "name").distinct().groupBy("ka", "kb").agg(F.sort_array(F.collect_list("name")).alias("items"))
    result = covered.join(named.hint("shuffle_merge"), ["ka", "kb"], "left")
    return base.join(result.hint("shuffle_merge"), ["ka", "kb"], "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)
), lengths AS (SELECT DISTINCT n FROM windows), places AS (
  SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, lengths WHERE len(ws) >= n)
), hits AS (SELECT doc_id, item_id, n, p FROM places JOIN windows USING (n, gram)), hit_words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
