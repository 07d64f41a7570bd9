"""Line dedup by winnowing, in DataFrame functions alone.

Lines are what `\\n` separates; lines without a word are kept and skipped over. A line goes if it lies in a run of lines with at least
`least` characters that occurs at an earlier position too, by (id, line): a long line alone, or short ones together. An earlier position that shares lines with
the run doesn't count, so the first occurrence stays whole where a run repeats itself: of forty equal lines of ten characters five stay.

From each line the shortest run with that many characters is a window, and so is the one that ends with it; any repeated run
is covered by its own windows. Each window selects the smallest hash of its lines as its fingerprint, which equal windows must share.
Fingerprints at one position only are dropped; the windows of the others are compared whole (128 bits over their lines) and joined to the
first position that has the same lines. Windows that overlap join up, which extends each match both ways to its full length.
Positions meet only the first one of their window, never each other, and the joins spread each key over `SALTS` tasks,
so a line that a third of all rows share costs one row a position and no task gets them all.

Nulls and empty texts have no lines; null ids come first. Rows of the same id are told apart by their text; rows equal in both count as one
and are returned as often as they came. Very long texts take time in proportion to their lines. Empty tables give empty results. Only
id and text are read; `deduplicate` returns the other columns as they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import barred, unused

LEAST = 50
#: A hot key of a join is spread over so many tasks; adaptive splitting does the rest.
SALTS = 16


def _row(id: Column, text: Column) -> Column:
    """Tells rows apart: the id and a hash of the text."""
    return F.struct(id.alias("id"), F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("hash"))


def _lines(text: Column) -> Column:
    """(line, place) of the lines with a word."""
    split = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    return F.filter(split, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))


def _windows(least: int) -> Column:
    """lines * 2 ** 32 + start of each window, from the lengths of the lines (column `size`)."""
    n = F.size("size")

    def reach(j: Column, step: int) -> Column:
        """How many lines from j on make a window; 0: there are too few. Lines have a character at least, so `least` are enough."""
        room = F.least(F.lit(least), n - j if step > 0 else j + 1)
        more = F.aggregate(
            F.sequence(F.lit(0), room - 1), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")),
            lambda acc, k: F.when(acc["sum"] >= least, acc).otherwise(F.struct((acc["sum"] + F.get("size", j + k * step)).alias("sum"), (acc["n"] + 1).alias("n"))),
        )
        return F.when(F.get("size", j) >= least, F.lit(1)).otherwise(F.when(more["sum"] >= least, more["n"]).otherwise(F.lit(0)))

    def side(step: int) -> Column:
        code = lambda j, k: F.when(k > 0, F.shiftleft(k.cast("bigint"), 32) + (j if step > 0 else j - k + 1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda j: code(j, reach(j, step)))

    found = F.when(n > 0, F.concat(side(1), side(-1))).otherwise(F.array().cast("array<bigint>"))
    return F.filter(F.array_distinct(found), lambda x: x.isNotNull())


def windows(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(row, start, n, a, b, fp, at, k1, k2): each window's first line among those with a word, the number of its lines, its places from a to b among all lines,
    its fingerprint with its place, and the hash of its lines."""
    rows = docs.select(_row(F.col(id), F.col(text)).alias("row"), _lines(F.col(text)).alias("lines"))
    rows = barred(
        rows.select(
            "row", F.col("lines.i").alias("places"), F.transform("lines", lambda x: F.length(x["line"])).alias("size"),
            F.transform("lines", lambda x: F.xxhash64(x["line"])).alias("h1"), F.transform("lines", lambda x: F.xxhash64(F.lit("second"), x["line"])).alias("h2"),
        )
    )
    coded = barred(rows.select("row", "places", "h1", "h2", _windows(least).alias("codes")))

    def window(code: Column) -> Column:
        start, n = code.bitwiseAND(F.lit(2**32 - 1)).cast("int"), F.shiftright(code, 32).cast("int")
        one, two = F.slice("h1", start + 1, n), F.slice("h2", start + 1, n)
        return F.struct(
            start.alias("start"), n.alias("n"), F.get("places", start).alias("a"), F.get("places", start + n - 1).alias("b"), F.array_min(one).alias("fp"),
            (start + F.array_position(one, F.array_min(one))).cast("int").alias("at"), F.xxhash64(n, one).alias("k1"), F.xxhash64(n, two).alias("k2"),
        )

    return coded.select("row", F.explode_outer(F.transform("codes", window)).alias("w")).filter(F.col("w").isNotNull()).select("row", "w.*")


def _salted(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """An equi-join that deals each key of `big`, by its position, over `SALTS` tasks."""
    left = big.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)).cast("int"))
    right = small.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(SALTS)])))
    return left.join(right, [*on, "salt"], how).drop("salt")


def removed_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(row, gone): the (first, last) places, from 0, among all lines of the windows that go; rows that lose none are not listed."""
    found = windows(docs, id, text, least)
    where = F.struct("row", "at")
    shared = found.groupBy("fp").agg(F.min(where).alias("a"), F.max(where).alias("b")).filter(F.col("a") != F.col("b")).select("fp")
    found = _salted(found, shared, ["fp"], "left_semi")
    here = F.struct("row", "start")
    first = found.groupBy("k1", "k2").agg(F.min(here).alias("first"), F.max(here).alias("last")).filter(F.col("first") != F.col("last")).drop("last")
    apart = ~F.col("row").eqNullSafe(F.col("first.row")) | (F.col("start") >= F.col("first.start") + F.col("n"))
    later = _salted(found, first, ["k1", "k2"], "inner").filter((here > F.col("first")) & apart)
    return later.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("gone"))


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """`docs` with the text of each row without the lines that go, and two counts of lines, `_lines` and `_gone`, with more
    underscores in front where `docs` has such columns.
    """
    row, late, spans, every, lines, n_lines, n_gone = (unused(docs, name) for name in ("_row", "_late", "_spans", "_every", "_places", "_lines", "_gone"))
    gone = removed_lines(docs, id, text, least).select(F.col("row").alias(late), F.col("gone").alias(spans))
    rows = docs.withColumn(row, _row(F.col(id), F.col(text)))
    same = F.col(f"{row}.id").eqNullSafe(F.col(f"{late}.id")) & (F.col(f"{row}.hash") == F.col(f"{late}.hash"))
    out = rows.join(gone, same, "left").select(*docs.columns, spans)
    # Set operations on whole numbers take time in proportion to their sizes; lookups in arrays don't.
    covered = F.flatten(F.transform(spans, lambda s: F.sequence(s["a"], s["b"])))
    worded = F.transform(_lines(F.col(text)), lambda x: x["i"])
    out = barred(out.select(*docs.columns, F.split(text, "\n").alias(every), F.when(F.col(spans).isNotNull(), F.array_intersect(worded, covered)).alias(lines)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), lines), lambda i: F.get(every, i))
    whole = F.col(lines).isNull()
    stays = F.when(whole, F.col(text)).otherwise(F.array_join(kept, "\n"))
    return out.select(
        *[stays.alias(c) if c == text else F.col(c) for c in docs.columns],
        F.when(F.coalesce(F.col(text), F.lit("")) == "", F.lit(0)).otherwise(F.size(every)).cast("long").alias(n_lines),
        F.when(whole, F.lit(0)).otherwise(F.size(lines)).cast("long").alias(n_gone),
    )


def op4(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
c AS (
  SELECT doc_id, line, i, length(line) AS n, row_number() OVER o AS j, sum(length(line)) OVER o AS upto FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT a.doc_id, a.j AS s, b.j AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.j BETWEEN a.j AND a.j + 49 AND b.upto - a.upto + a.n >= 50),
w AS (SELECT doc_id, s, min(e) AS e FROM p GROUP BY doc_id, s UNION SELECT doc_id, max(s), e FROM p GROUP BY doc_id, e),
k AS (SELECT w.doc_id, s, list(i ORDER BY j) AS places, list(line ORDER BY j) AS lines FROM w JOIN c ON w.doc_id = c.doc_id AND j BETWEEN s AND e GROUP BY w.doc_id, s, e),
f AS (SELECT doc_id, s, places, first_value(doc_id) OVER o AS d0, first_value(s) OVER o AS s0 FROM k WINDOW o AS (PARTITION BY lines ORDER BY doc_id, s)),
gone AS (SELECT DISTINCT doc_id, unnest(places) AS i FROM f WHERE doc_id <> d0 OR s >= s0 + len(places)),
kept AS (
  SELECT l.doc_id, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS t
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
