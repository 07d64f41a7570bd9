"""Spelling variants: all pairs of words one edit apart, by merging the subtrees of a trie, and the form that each word belongs to.

The words' prefixes are the nodes of a trie. Each node's largest subtree is its heavy child, the others are light; a word lies in at most log2(words) light
subtrees, which bounds all that follows. Light subtrees are merged, small to large, with one character replaced or skipped: where a word
enters a light subtree, its rest is looked up below the node itself (skipped) and below the heavy sibling (replaced, or with that sibling's
character before it), and the rests of all light siblings are put together. Terminals that coincide are words one edit apart. Two words part
at one node, and one of them enters a light subtree there (or ends, and the other has one character more), so each pair is found once.

All of it is joins and groups of strings: lookups are equi-joins to the table of words, and siblings meet by (node, rest), at most one for each character.
Short prefixes, which many words share, are broadcast: there are at most `len(ALPHABET) ** SHORT` of them. Longer ones are left to adaptive skew
splitting. Neither words nor pairs go through the driver or one task.

Null and empty texts and texts without a word have no words, a null id counts as an empty one. Very long texts take time in proportion to their
length; a run of letters is one word, however long, and a word that occurs twice has a node for each of its letters, so its prefixes take the square of its length. Rows that repeat, with the same id or not, count as often as they come. Ties are broken by code points. An
empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import lower_ascii, written

#: What a word is made of after A-Z are lower-cased, and in a Java expression.
ALPHABET = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
LETTERS = r"a-zÀ-ÿ"
LENGTH, SEEN, RATIO = 7, 2, 10
#: Prefixes up to this length are broadcast: 90 + 90 ** 2 at most.
SHORT = 2
MISSING = "*"


def runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LENGTH) -> DataFrame:
    """(id, run): the maximal runs of letters with at least `least` code points, lower-cased, as often as they occur."""
    found = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select(F.col(id).alias("id"), F.explode_outer(found).alias("run")).filter("run is not null")


def without(word: Column, at: Column) -> Column:
    """The word without its code point at `at`, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def counted(words: DataFrame, least: int = LENGTH, seen: int = SEEN) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= seen)


def light_subtrees(words: DataFrame) -> DataFrame:
    """(prefix, heavy): the roots of the light subtrees, and the character of their heavy sibling (of equal ones the last)."""
    each = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", F.lit(1), i))).alias("prefix"))
    sizes = each.groupBy("prefix").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("parent", F.substring("prefix", F.lit(1), F.length("prefix") - 1)).withColumn("c", F.substring("prefix", F.length("prefix"), F.lit(1)))
    # A node has a child for each character at most.
    largest = F.max(F.struct("size", "c")).over(W.partitionBy("parent"))
    return sizes.withColumn("heavy", largest["c"]).filter(F.col("c") != F.col("heavy")).select("prefix", "heavy")


def entered(words: DataFrame) -> DataFrame:
    """(word, n, i, heavy): the depths, from 0, at which a word enters a light subtree."""
    light = written(light_subtrees(words), "subtrees")
    each = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("depth")).withColumn("prefix", F.substring("word", F.lit(1), F.col("depth")))
    short, long = F.col("depth") <= SHORT, F.length("prefix") > SHORT
    found = each.filter(short).join(F.broadcast(light.filter(~long)), "prefix").unionByName(each.filter(~short).join(light.filter(long), "prefix"))
    return found.select("word", "n", (F.col("depth") - 1).alias("i"), "heavy")


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near ones: how many, and of the most frequent ones the first by code points.

    `words`: (word, n), each word once."""
    light = written(entered(words), "entered")
    word, i = F.col("word"), F.col("i")
    head, tail, own, then = F.substring(word, F.lit(1), i), F.substring(word, i + 2, F.length(word)), F.substring(word, i + 1, F.lit(1)), F.substring(word, i + 2, F.lit(1))
    # The same word comes from each character of a run of equal ones; the last of them is the one where the words part.
    skipped = F.when((own != then) & (then != ""), F.concat(head, tail))
    merged = light.select("word", "n", F.explode(F.array(F.concat(head, F.col("heavy"), tail), F.concat(head, F.col("heavy"), own, tail), skipped)).alias("other")).filter("other is not null")
    ended = words.select("word", "n", F.expr("left(word, length(word) - 1)").alias("other"))
    pairs = merged.unionByName(ended).join(words.select(word.alias("other"), F.col("n").alias("other_n")), "other")
    both = F.array(F.struct(word, F.col("other_n").alias("best_n"), F.col("other").alias("best")), F.struct(F.col("other").alias("word"), F.col("n").alias("best_n"), word.alias("best")))
    found = pairs.select(F.inline(both)).select("word", F.lit(1).cast("bigint").alias("n_near"), F.struct((-F.col("best_n")).alias("less"), "best").alias("first"))

    # Light siblings with the same rest: one for each character at most.
    alike = light.groupBy(F.concat(head, F.lit(MISSING), tail).alias("key")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), word.alias("best")))).alias("all")).filter(F.size("all") > 1)
    siblings = alike.select("all", F.posexplode("all").alias("at", "one")).select(
        F.col("one.best").alias("word"), (F.size("all") - 1).cast("bigint").alias("n_near"), F.when(F.col("at") == 0, F.get("all", F.lit(1))).otherwise(F.get("all", F.lit(0))).alias("first")
    )
    seen = found.unionByName(siblings).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("first").alias("first"))
    return seen.select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of all `words` (word, n): the most frequent near word is a word's form if it occurs at least `ratio` (over 1)
    times as often; the root is where forms lead to."""
    words = written(words, "words")
    seen = words.join(near(words), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    rows = seen.select("word", "n", F.when(is_form, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n"))
    rows = written(rows, "forms")
    # Each step multiplies n by the ratio, so chains are short, and each round doubles the steps taken.
    most = rows.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, ratio)))
    roots = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(steps.bit_length()):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return rows.join(roots, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def op13(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    damaged = F.when(F.col("h") % 31 == 0, without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    words = runs(docs).select("run", h.alias("h")).select(damaged.alias("word"))
    return variants(counted(words)).select("word", "form", "root", "n", "n_near", "form_n")
