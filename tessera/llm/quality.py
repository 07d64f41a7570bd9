"""Quality rules in DataFrame functions alone: base counts, and a log-likelihood ratio of n-grams.

Words and pairs of neighbouring words are counted as they are (by 64-bit hashes) in two multinomials: one over every row of the
corpus, one over all of its trusted rows. A document's ratio is the sum of log p(trusted) - log p(corpus) over its n-grams, divided
by their number, and it is kept if the ratio is at least `threshold` and the base rules hold. No document is drawn at random: equal
texts get equal verdicts.

`gram_ratios` counts n-grams that are frequent in some of the rows (at most `FREQUENT`, which are broadcast) where the text is read, and sums their ratios
there too. The occurrences of all others meet by n-gram, are counted and give each row its share at once (those seen once, in a row that isn't trusted,
have ratio 0). They do so in `PARTS` parts, by hashes of first words: each part reads the texts again, and its shuffle files go before the next begins. `ratios` is the form in a
fixed number of buckets, for small corpora: one array, no join; as the buckets fill up its ratios go to 0.

Nulls and empty texts have no words: all counts are 0 and the base rules fail. Rows that repeat are judged one by one. Null ids
are never trusted. Without a trusted row that has words all ratios are 0, so the base rules alone decide. A ratio equal to the threshold is
kept. Very long texts take time in proportion to their length, and to its logarithm where they repeat windows. Empty tables give empty
results. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, barred, ngram_hashes, tidy, words, written

BUCKETS = 1 << 16
TRUSTED_ROWS = 50_000
THRESHOLD = -0.1
SMOOTHING = 2.0
MIN_WORDS = 50
MAX_REPEATED = 50
#: So many n-grams at most are broadcast: the most frequent of the rows of which one in `LOOKED_AT` is looked at. Any set gives the same ratios.
FREQUENT, LOOKED_AT = 50_000, 16
#: The other n-grams are counted in so many parts, one after the other, so that only one part's occurrences lie on disk at a time.
PARTS = 4
#: Bits in which a window's place is kept beside the upper bits of its hash.
PLACE = 20
#: Up to so many trusted ids are broadcast, more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _buckets(words: Column, buckets: int) -> Column:
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    return F.concat(F.transform(words, lambda w: bucket(F.xxhash64(w))), F.transform(ngram_hashes(words, 2), bucket))


def ratios(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> np.ndarray:
    """The log ratio of each bucket. `trusted` has the ids of the rows to imitate.

    Both multinomials are smoothed alike (by `SMOOTHING` trusted occurrences), and the corpus counts leave one occurrence out, the one
    that is scored: else a rare n-gram of a document that isn't trusted would speak against it by its mere presence.
    """
    ids = trusted.select(F.col(id).alias("id")).filter(F.col("id").isNotNull()).distinct().orderBy(F.xxhash64("id"), "id").limit(trusted_rows).withColumn("good", F.lit(1))
    grams = docs.select(F.col(id).alias("id"), words(F.col(text)).alias("words")).select("id", _buckets(F.col("words"), buckets).alias("bs"))
    counts = (
        grams.join(F.broadcast(ids), "id", "left").select("good", F.explode_outer("bs").alias("b"))
        .groupBy("b").agg(F.count("*").alias("raw"), F.count("good").alias("good"))
        .filter(F.col("b").isNotNull()).collect()
    )
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for r in counts:  # at most `buckets` rows
        raw[r["b"]], good[r["b"]] = r["raw"], r["good"]
    if not good.any():
        return np.zeros(buckets)
    share = good.sum() / raw.sum()
    return np.log((good + SMOOTHING) / (share * np.maximum(raw - 1, 0) + SMOOTHING))


def _row(id: str, text: str) -> Column:
    """What rows equal in id and text share."""
    return F.xxhash64(F.col(id), F.col(text))


def _grams(rows: DataFrame, part: int | None = None) -> DataFrame:
    """(row, good, gram) for each word and pair of neighbouring words of (row, good, text) rows.

    part: only words, and pairs whose first word, has a hash in that one of `PARTS`; what falls away does so before pairs are made.
    """
    split = rows.select("row", "good", F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), SPACES).alias("ws"))
    both = F.arrays_zip(F.col("ws").alias("w"), F.slice("ws", F.lit(2), F.size("ws")).alias("v"))
    pairs = split.select("row", "good", F.explode_outer(both).alias("p")).select("row", "good", F.col("p")["w"].alias("w"), F.col("p")["v"].alias("v")).filter("w <> ''")
    pairs = pairs.withColumn("h", F.xxhash64("w"))
    if part is not None:
        pairs = pairs.filter(F.pmod("h", F.lit(PARTS)) == part)
    grams = F.array("h", F.when(F.col("v").isNotNull(), F.xxhash64("w", "v")))
    return pairs.select("row", "good", F.explode(grams).alias("gram")).filter(F.col("gram").isNotNull())


def gram_ratios(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, sum): for each row that has n-grams with a log ratio other than 0 their sum, smoothed and leaving one out as in `ratios`."""
    spark = docs.sparkSession
    tidy(spark)
    ids = trusted.select(F.col(id).alias("id")).filter(F.col("id").isNotNull()).distinct().withColumn("good", F.lit(1))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(ids, "id", "left").select(_row("id", "text").alias("row"), "good", "text")

    some = _grams(rows.filter(F.pmod("row", F.lit(LOOKED_AT)) == 0)).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    often = written(some.orderBy(F.desc("n"), "gram").limit(FREQUENT).select("gram", F.lit(True).alias("often")), "often")
    counted = _grams(rows).join(F.broadcast(often), "gram", "left").select(F.when(F.col("often"), F.col("gram")).alias("gram"), "good")
    counts = written(counted.groupBy("gram").agg(F.count("*").alias("raw"), F.count("good").alias("good")), "counts")
    raw, good = counts.agg(F.sum("raw"), F.sum("good")).first()
    if not good:
        return spark.createDataFrame([], "row long, sum double")
    llr = F.log((F.col("good") + SMOOTHING) / (good / raw * (F.col("raw") - 1) + SMOOTHING))

    known = counts.filter(F.col("gram").isNotNull()).select("gram", llr.alias("llr"))
    sums = written(_grams(rows).join(F.broadcast(known), "gram").groupBy("row").agg(F.sum("llr").alias("sum")), "sums")
    same = Window.partitionBy("gram")
    for part in range(PARTS):
        rare = _grams(rows, part).join(F.broadcast(often), "gram", "left_anti")
        rare = rare.select("row", F.count("*").over(same).alias("raw"), F.count("good").over(same).alias("good")).select("row", llr.alias("llr")).filter("llr <> 0")
        sums = sums.unionByName(written(rare.groupBy("row").agg(F.sum("llr").alias("sum")), "sums"))
    copies = rows.groupBy("row").agg(F.count("*").alias("copies")).filter("copies > 1")
    return sums.groupBy("row").agg(F.sum("sum").alias("sum")).join(copies, "row", "left").select("row", (F.col("sum") / F.coalesce("copies", F.lit(1))).alias("sum"))


def _alike(marks: Column) -> Column:
    """The places of windows whose hash another window may have: `marks` are hashes in order, each with its place in the lowest `PLACE` bits."""
    upper = lambda x: F.shiftright(x, PLACE)
    same = lambda x, other: F.coalesce(upper(x) == upper(other), F.lit(False))
    met = F.filter(marks, lambda x, i: same(x, F.get(marks, i + 1)) | same(x, F.get(marks, i - 1)))
    return F.transform(met, lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"))


def _repeated(ordered: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more; `ordered`: (hash, place) pairs in order."""
    same = lambda i, by: F.coalesce(F.get(ordered, i)["h"] == F.get(ordered, i + by)["h"], F.lit(False))
    places = F.transform(F.filter(ordered, lambda x, i: same(i, 1) | same(i, -1)), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    return F.size(F.array_distinct(F.flatten(places)))


def measure(docs: DataFrame, llr: np.ndarray | DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept.

    Filters on the result stay above the arrays it is made from, which are built once a row.
    """
    exact = isinstance(llr, DataFrame)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = barred(
        docs.select(
            F.col(id).alias("id"),
            _row(id, text).alias("row"),
            F.array_remove(F.split(t, SPACES), "").alias("words"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        )
    )
    if exact:
        ratio = F.lit(0.0)
    else:
        table = F.split(F.lit(",".join(f"{x:.9g}" for x in llr)), ",").cast("array<double>")
        rows = barred(rows.withColumn("bs", _buckets(F.col("words"), len(llr))))
        total = F.aggregate("bs", F.lit(0.0), lambda acc, b: acc + F.element_at(table, b + 1))
        ratio = F.when(F.size("bs") > 0, F.round(total / F.size("bs"), 9)).otherwise(F.lit(0.0))
    following = lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
    rows = barred(
        rows.select(
            "id",
            "row",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            "n_symbols",
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.slice(F.transform("words", following), F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))).alias("h"),
            ratio.alias("ratio"),
        )
    )
    # Only texts that repeat a window are sorted: as numbers first, then, as pairs, what may be equal there; very long ones as pairs at once.
    marks = F.sort_array(F.transform("h", lambda h, i: h.bitwiseAND(F.lit(-1 << PLACE)).bitwiseOR(i.cast("long"))))
    short = F.size("h") <= 1 << PLACE
    rows = barred(rows.withColumn("again", F.size(F.array_distinct("h")) < F.size("h")).withColumn("marks", F.when(F.col("again") & short, marks)))
    places = F.when(short, _alike(F.col("marks"))).otherwise(F.sequence(F.lit(0), F.size("h") - 1))
    rows = barred(rows.withColumn("places", F.when(F.col("again"), places)).drop("marks"))
    pairs = F.sort_array(F.transform("places", lambda i: F.struct(F.get("h", i).alias("h"), i.alias("i"))))
    rows = barred(rows.withColumn("ordered", F.when(F.col("again"), pairs)).drop("h", "again", "places"))
    rows = rows.withColumn("n_repeat_words", F.when(F.col("ordered").isNull(), F.lit(0)).otherwise(_repeated(F.col("ordered"))).cast("long")).drop("ordered")
    if exact:
        rows = rows.join(llr, "row", "left").withColumn("ratio", F.round(F.coalesce("sum", F.lit(0.0)) / F.greatest(2 * F.col("n_words") - 1, F.lit(1)), 9))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
    return rows.select(F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept")


def op10(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.col("quality") == 1).select("doc_id")
    return measure(docs, gram_ratios(docs, trusted)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")
