"""Document fingerprints by winnowing, in DataFrame functions alone.

A text's words are its runs without white space; a run of more than `CUT` code points counts as several words of that length, so that
scripts without spaces have words too. Every run of `GRAM` words has a hash, and every `WINDOW` consecutive hashes choose their
smallest one, of equal ones the rightmost. What any window chose is the fingerprint: (hash, at), in order, with the number of its first word.
Two texts that share `GRAM + WINDOW - 1` words in a row share a chosen hash, wherever those words stand.

The minima of all windows are found by doubling: places of minima over 1, 2, 4, ... hashes are joined to those that lie so many further on.
`followed` brings each document its successor: documents are dealt into ranges of (id, hash of the text), so that one exchange of the texts is
enough, and the first document of each range is sent to the end of the range before it, too.

Nulls: a null text is an empty one; null ids come first. Texts of fewer than `GRAM` words have one hash over all words; those without a word have an
empty fingerprint, and two empty ones are alike (1.0). Fewer hashes than a window holds are one window. Rows of the same id follow
each other by the hash of their text; rows equal in both are told apart by nothing, follow each other and share a task. Very long texts take time
in proportion to their words. An empty table gives an empty result; a table of one row is its own successor. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import unused

GRAM, WINDOW, CUT = 5, 4, 12
#: Documents in a range, and the most ranges: their first keys go through the driver. More documents make larger ranges, which spill.
RANGE, RANGES = 1000, 20_000


def bound(value: Column, use) -> Column:
    """`use(value)` with the value evaluated once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\x20\x09-\x0D]{{1,{CUT}}}"), F.lit(0))


def _grams(words: Column, gram: int) -> Column:
    """The hash of each run of `gram` words; of all words where there are fewer, and none without words."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - gram), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(gram)]))
    return F.when(n >= gram, runs).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _minima(hashes: Column, window: int) -> Column:
    """The places of each window's smallest hash, the rightmost of equal ones; each place once, in order."""

    def lower(x: Column, y: Column) -> Column:
        return F.when(y.isNull() | (F.get(hashes, x) < F.get(hashes, y)), x).otherwise(y)

    def widened(step: int):
        return lambda p: F.zip_with(p, F.slice(p, step + 1, F.greatest(F.size(p) - step, F.lit(0))), lower)

    places, reach = F.sequence(F.lit(0), F.size(hashes) - 1), 1
    while reach < window:
        step = min(reach, window - reach)
        places, reach = bound(places, widened(step)), reach + step
    whole = bound(places, lambda p: F.slice(p, 1, F.greatest(F.size(p) - (window - 1), F.lit(1))))
    return F.array_distinct(whole)


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """array<struct<hash bigint, at int>> of a text."""

    def chosen(h: Column) -> Column:
        found = F.transform(_minima(h, window), lambda p: F.struct(F.get(h, p).alias("hash"), p.alias("at")))
        return F.when(F.size(h) > 0, found).otherwise(F.array().cast("array<struct<hash:bigint,at:int>>"))

    return bound(_words(text), lambda words: bound(_grams(words, gram), chosen))


def likeness(one: Column, two: Column) -> Column:
    """Shared hashes of two fingerprints among all of theirs, each counted once; two empty ones are alike."""
    both = F.size(F.array_union(one["hash"], two["hash"]))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(one["hash"], two["hash"])) / both)


def _key(id: Column, text: Column) -> Column:
    """Text that sorts as (id, hash of the text), null ids first; `id` is a whole number."""
    ordered = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.when(id.isNull(), F.lit("0")).otherwise(F.lit("1")), ordered(F.coalesce(id.cast("bigint"), F.lit(0))), ordered(F.xxhash64(text)))


def _range_of(key: Column, firsts: list[str]) -> Column:
    """The number of the last of `firsts` (in order, the least key first) that isn't above the key, by binary search."""
    table, steps = F.split(F.lit(",".join(firsts)), ","), [2**b for b in reversed(range(len(firsts).bit_length()))]
    at = lambda i, s: F.when(F.coalesce(F.get(table, i + s), F.lit("~")) <= key, i + s).otherwise(i)  # noqa: E731  no key is above "~"
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), at)


def followed(docs: DataFrame, id: str, text: str, made: dict[str, Column], per_range: int = RANGE) -> DataFrame:
    """(id, text, `made`..., next): each row with the columns `made` from id and text, and `next`, a struct of the text and `made` columns of the row that
    follows in order of the id; the first one follows the last."""
    rows = docs.select(id, F.coalesce(F.col(text), F.lit("")).alias(text))
    key, guest, part, to = (unused(rows, name) for name in ("_key", "_guest", "_part", "_to"))
    keyed = rows.withColumn(key, _key(F.col(id), F.col(text)))
    n = max(1, min(RANGES, rows.count() // per_range))
    # Only keys are exchanged here; the first one of each range, at most RANGES, goes through the driver.
    firsts = sorted(r["k"] for r in keyed.select(key).repartitionByRange(n, key).groupBy(F.spark_partition_id()).agg(F.min(key).alias("k")).collect())
    if not firsts:
        firsts = ["0"]
    number = _range_of(F.col(key), firsts)
    # The first row of a range also goes to the end of the range before, that of the first range to the last.
    home = F.struct(F.col(part).alias("part"), F.lit(0).alias("guest"))
    away = F.struct(F.pmod(F.col(part) - 1, F.lit(len(firsts))).alias("part"), F.lit(1).alias("guest"))
    first = F.get(F.split(F.lit(",".join(firsts)), ","), F.col(part)) == F.col(key)
    dealt = keyed.withColumn(part, number).withColumn(to, F.explode_outer(F.when(first, F.array(home, away)).otherwise(F.array(home))))
    dealt = dealt.select(id, text, key, F.col(f"{to}.part").alias(part), F.col(f"{to}.guest").alias(guest))
    dealt = dealt.repartition(part).sortWithinPartitions(part, guest, key)
    dealt = dealt.select(id, text, key, part, guest, *[c.alias(name) for name, c in made.items()])
    after = W.partitionBy(part).orderBy(guest, key)
    out = dealt.withColumn("next", F.lead(F.struct(text, *made)).over(after))
    return out.filter(F.col(guest) == 0).select(id, text, *made, "next")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half, rounded down, replaced by as many code points of the next text, or all that it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def op12(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = followed(docs, "doc_id", "text", {"print": fingerprint(F.col("text"))})
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next.text")).alias("edited"), "print", F.col("next.print").alias("next_print"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "print", "next_print", fingerprint(F.col("edited")).alias("edited_print"))
    one, two, other = F.col("print"), F.col("edited_print"), F.col("next_print")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", one["hash"].alias("fingerprint"), two["hash"].alias("edited_fingerprint"), likeness(one, two).alias("near_edited"), likeness(one, other).alias("near_next"),
        one["at"].alias("places"), two["at"].alias("edited_places"),
    )
