"""Reports: rollups, coverage, telemetry, progress and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import extension

DEPTH = 3


def directory_rollup(files: DataFrame, path: str = "path", depth: int = DEPTH, occurrences: str | None = None) -> DataFrame:
    """Files and, if there is such a column, occurrences of each folder down to `depth`; the root is '' at 0.

    Each file makes at most depth + 1 rows, which are summed up before they are shuffled.
    """
    parts = F.split(path, "/")
    levels = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(depth))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("directory")))
    n = [F.count("*").alias("files")] + ([F.sum(occurrences).alias("occurrences")] if occurrences else [])
    return files.select(F.explode_outer(levels).alias("l"), *([occurrences] if occurrences else [])).groupBy("l.depth", "l.directory").agg(*n)


def top_references(references: DataFrame, column: str = "reference", limit: int = 20) -> DataFrame:
    return references.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit)


def overview(files: DataFrame, references: DataFrame, path: str = "path") -> DataFrame:
    """(part, depth, name, n): the folders with their files, the entry points, and the references that most files name."""
    from tessera.operators.classify import is_entry_point

    none = F.lit(None).cast("int")
    tree = directory_rollup(files, path).select(F.lit("tree").alias("part"), "depth", F.col("directory").alias("name"), F.col("files").alias("n"))
    entries = files.filter(is_entry_point(F.col(path))).select(F.lit("entry_point").alias("part"), none.alias("depth"), F.col(path).alias("name"), F.lit(1).cast("bigint").alias("n"))
    named = top_references(references).select(F.lit("reference").alias("part"), none.alias("depth"), F.col("reference").alias("name"), "n")
    return tree.unionByName(entries).unionByName(named)


def cached_overview(files: DataFrame, references: DataFrame, root: str, path: str = "path", content: str = "content_hash") -> DataFrame:
    """`overview`, kept under the hash of the files' manifest: the same files are only looked at once."""
    from tessera.sources.files import manifest_hash

    spark = files.sparkSession
    folder = f"{root}/{manifest_hash(files, path, content).first()[0]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        overview(files, references, path).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def unaccounted(candidates: DataFrame, accounted: DataFrame, key: str = "path", path: str = "path", examples: int = 10) -> DataFrame:
    """Files of no table by extension, most first, with the first few as examples."""
    rows = candidates.join(accounted, key, "left_anti").withColumn("extension", extension(F.col(path)))
    nth = F.row_number().over(W.partitionBy("extension").orderBy(path))
    first = rows.withColumn("_n", nth).filter(F.col("_n") <= examples).groupBy("extension").agg(F.array_sort(F.collect_list(path)).alias("examples"))
    return rows.groupBy("extension").agg(F.count("*").alias("n")).join(first, "extension").orderBy(F.desc("n"), "extension")


def progress(rows: DataFrame, done: Column, lately: Column, minutes: float = 5.0) -> DataFrame:
    """One row: done, total, pct, those of the last minutes by minute, and the minutes to go (null without any lately)."""
    x = rows.agg(F.count(F.when(done, 1)).alias("done"), F.count("*").alias("total"), F.count(F.when(lately, 1)).alias("_lately"))
    pct = F.when(F.col("total") > 0, F.round(100.0 * F.col("done") / F.col("total"), 6))
    return x.select("done", "total", pct.alias("pct"), F.round(F.col("_lately") / minutes, 6).alias("per_minute"), F.when(F.col("_lately") > 0, (F.col("total") - F.col("done")) / (F.col("_lately") / minutes)).alias("minutes_left"))


def coverage(expected: DataFrame, ready: DataFrame, failed: DataFrame, by: str, key: str = "subject") -> DataFrame:
    """(by, expected, ready, failed): what failed is at most what is not ready."""
    r = ready.select(key).distinct().withColumn("_r", F.lit(1))
    f = failed.select(key).distinct().withColumn("_f", F.lit(1))
    rows = expected.join(r, key, "left").join(f, key, "left").groupBy(by).agg(F.count("*").alias("expected"), F.count("_r").alias("ready"), F.count("_f").alias("_failed"))
    return rows.select(by, "expected", "ready", F.least(F.col("expected") - F.col("ready"), "_failed").alias("failed"))


def telemetry(calls: DataFrame, tool: str, order: str, last: int = 500) -> DataFrame:
    """Over the last calls of each tool: calls, errors, bytes and milliseconds."""
    n = F.row_number().over(W.partitionBy(tool).orderBy(F.desc(order)))
    return calls.withColumn("_n", n).filter(F.col("_n") <= last).groupBy(tool).agg(
        F.count("*").alias("calls"), F.count(F.when(F.col("error"), 1)).alias("errors"), F.sum("bytes").alias("bytes"), F.round(F.sum("ms"), 4).alias("total_ms")
    )


def divergence(heads: DataFrame) -> DataFrame:
    """The first way in which each head differs from what is expected, null if it is valid."""
    ladder = (
        F.when(F.col("head_generation").isNull(), "missing_head")
        .when(F.col("head_generation") != F.col("generation"), "generation")
        .when(F.col("head_schema") != F.col("schema"), "schema_version")
        .when(F.col("head_tokenizer") != F.col("tokenizer"), "tokenizer_version")
        .when(F.col("head_count") != F.col("count"), "count")
        .when(F.col("head_manifest") != F.col("manifest"), "manifest_hash")
    )
    return heads.withColumn("divergence", ladder)


def range_counts(ranges: DataFrame, points: DataFrame, key: str, low: str, high: str, at: str, id: str) -> DataFrame:
    """(id, n): how many points of the key lie from low to high, both included.

    Points and ends of ranges are sorted together and points are counted once along the order, so a key with many of both costs no
    more than its rows; nothing is joined.
    """
    ends = lambda c, side, sign: ranges.select(F.col(key).alias("k"), F.col(c).alias("at"), F.lit(side).alias("side"), F.lit(0).alias("point"), F.lit(sign).alias("sign"), F.col(id).alias("id"))
    none = F.lit(None).cast(dict(ranges.dtypes)[id])
    seen = points.select(F.col(key).alias("k"), F.col(at).alias("at"), F.lit(1).alias("side"), F.lit(1).alias("point"), F.lit(0).alias("sign"), none.alias("id"))
    before = F.sum("point").over(W.partitionBy("k").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0))
    every = ends(low, 0, -1).unionByName(ends(high, 2, 1)).unionByName(seen).withColumn("before", before)
    return every.filter("sign <> 0").groupBy(F.col("id").alias(id)).agg(F.greatest(F.sum(F.col("sign") * F.col("before")), F.lit(0)).alias("n"))
