"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

Every benchmark item is cut into windows of `window` consecutive words (an item of fewer words is one window). The shingles
of a window are ordered by how rare they are in the corpus, and only the rarest one, the necessary prefix, is joined against
the shingles of the documents. A candidate must fit in the document before its words are compared with the window's,
word for word. No document text is shuffled: the words stay in the row that is compared.

Windows are broadcast in blocks of at most `block` windows, so that what is broadcast has a fixed bound and a larger
benchmark only means more blocks.

Every explode is an outer one: for a plain explode the optimizer adds a test of the array's size below the projection that
splits the text, and so evaluates the split again for each element.

Nulls: a null text has no words, a null item has no windows; both rows keep their place in the result. Empty tables give
empty results. Rows that repeat, with the same id or not, are judged one by one. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NOT_WORD, lower_ascii, ngram_hashes, words

WINDOW = 10
SHINGLE = 3
BLOCK = 200_000


def item_windows(bench: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(w_words, w_len, items): each distinct window once, with the sorted ids of the items that have it."""
    w = bench.select(F.col(item).alias("item"), words(lower_ascii(F.col(text)), NOT_WORD).alias("words"))
    n = F.size("words")
    w = w.filter(n > 0).select(
        "item",
        F.explode_outer(
            F.when(
                n >= window,
                F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.slice("words", i.cast("int"), window)),
            ).otherwise(F.array("words"))
        ).alias("w_words"),
    )
    return w.groupBy("w_words").agg(F.collect_set(F.col("item").cast("string")).alias("items")).withColumn("w_len", F.size("w_words"))


def _tokens(w_words, sizes: list[int]):
    """The shingles of a window as (hash, offset) pairs, of the one size that windows of its length use."""
    return reduce(
        lambda rest, s: F.when(
            F.least(F.size(w_words), F.lit(max(sizes))) == s,
            F.transform(ngram_hashes(w_words, s), lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("offset"))),
        ).otherwise(rest),
        sizes,
        F.array().cast("array<struct<h:bigint,offset:int>>"),
    )


def hits(docs: DataFrame, bench: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row for each document row: id, row (a hash of id and text), its words' count, and `found`, the (start, length, items) of each window found."""
    spark = docs.sparkSession
    shingle = min(shingle, window)
    windows = item_windows(bench, item, item_text, window)
    lengths = [r[0] for r in windows.select(F.least("w_len", F.lit(shingle)).alias("s")).distinct().collect()]  # at most `shingle` values
    sizes = sorted(lengths) or [shingle]
    n_windows = windows.count()
    blocks = max(1, math.ceil(n_windows / block))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("w_words"), F.lit(blocks)).cast("int"))

    base = docs.select(F.col(id).alias("id"), F.xxhash64(F.col(id).cast("string"), F.col(text)).alias("row"), words(lower_ascii(F.col(text)), NOT_WORD).alias("words"))
    placed = lambda h, i: F.struct(h.alias("h"), (i + 1).cast("int").alias("pos"))
    with_tokens = base.withColumn("hs", F.concat(*[F.transform(ngram_hashes(F.col("words"), s), placed) for s in sizes]))
    found = []
    for b in range(blocks):
        part = windows.filter(F.col("block") == b)
        tokens = part.select("w_words", "w_len", "items", F.explode_outer(_tokens(F.col("w_words"), sizes)).alias("t")).select("w_words", "w_len", "items", "t.h", "t.offset")
        rare = (
            with_tokens.select(F.explode_outer("hs.h").alias("h"))
            .join(F.broadcast(tokens.select("h").distinct()), "h")
            .groupBy("h").agg(F.count("*").alias("seen"))
        )
        prefix = (
            tokens.join(rare, "h")
            .groupBy("w_words", "w_len")
            .agg(F.min(F.struct("seen", "offset", "h")).alias("p"), F.first("items").alias("items"))
            .select(F.col("p.h").alias("h"), F.col("p.offset").alias("offset"), "w_words", "w_len", "items")
        )
        if b == 0:  # a row that every document meets once, at position 0, so that all of them reach the result
            mark = spark.range(1).select(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("offset"), F.array().cast("array<string>").alias("w_words"), F.lit(0).alias("w_len"), F.array().cast("array<string>").alias("items"))
            prefix = prefix.unionByName(mark)
            source = with_tokens.withColumn("hs", F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("pos"))), F.col("hs")))
        else:
            source = with_tokens
        start = F.col("t.pos") - F.col("offset")
        found.append(
            source.select("id", "row", "words", F.explode_outer("hs").alias("t"))
            .join(F.broadcast(prefix), F.col("t.h") == F.col("h"))
            .filter(((F.col("t.pos") == 0) & (F.col("w_len") == 0)) | ((F.col("t.pos") > 0) & (F.col("w_len") > 0) & (start >= 1) & (start + F.col("w_len") - 1 <= F.size("words"))))
            .filter(F.when(F.col("w_len") == 0, F.lit(True)).otherwise(F.slice("words", F.greatest(start, F.lit(1)), F.col("w_len")) == F.col("w_words")))
            .select("id", "row", F.size("words").cast("long").alias("n_words"), start.cast("int").alias("start"), F.col("w_len").alias("len"), "items")
        )
    rows = reduce(DataFrame.unionByName, found)
    return (
        rows.groupBy("id", "row", "n_words")
        .agg(F.count(F.when(F.col("len") == 0, 1)).alias("copies"), F.collect_set(F.when(F.col("len") > 0, F.struct("start", "len", "items"))).alias("found"))
        .select("id", "row", "n_words", "found", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .drop("copy")
    )


def decontaminate(docs: DataFrame, bench: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """Per document row: id, n_words, spans (start, length of each window found), items (sorted), n_hit."""
    covered = F.array_distinct(F.flatten(F.transform("found", lambda f: F.sequence(f["start"], f["start"] + f["len"] - 1))))
    return hits(docs, bench, id, text, item, item_text, window, shingle, block).select(
        F.col("id").alias(id),
        "n_words",
        F.transform("found", lambda f: F.struct(f["start"].alias("start"), f["len"].alias("len"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda f: f["items"])))).alias("items"),
        F.size(covered).cast("long").alias("n_hit"),
    )


def op8(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, bench).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT item_id, CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: w[i:i+9]) ELSE [w] END AS ws FROM bw WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, array_to_string(k, ' ') AS k, len(k) AS n FROM (SELECT item_id, unnest(ws) AS k FROM win)),
dw AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
places AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS (
  SELECT r, p, places.n, item_id FROM places JOIN windows ON windows.n = places.n AND windows.k = array_to_string(w[p:p+places.n-1], ' ')),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
