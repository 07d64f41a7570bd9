"""Generations of a tree as intervals: a build writes what has changed, and every generation can still be read.

Under a root: `opened/generation=<n>` (path, revision), `closed/generation=<n>` (path, first), `parsed/generation=<n>` (what a parser made of revisions that had not been seen), and
`heads/generation=<n>`, one row, written last. A member is a path with a revision from its first generation to the last one before it is closed. Builds
overwrite what an unfinished one has left at their number, so a build that was cut off is started again. A projection is a
copy of one generation elsewhere, which is brought to another by the difference of the two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import manifest_hash


def _at(spark: SparkSession, root: str, kind: str, schema: str, upto: int) -> DataFrame:
    """Rows that generations up to `upto` have written; folders of unfinished ones lie beyond it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{schema}, generation int")
    return spark.read.schema(f"{schema}, generation int").parquet(f"{root}/{kind}").filter(F.col("generation") <= upto)


def head(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """(generation, hash of its manifest); (0, None) before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/heads/generation=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    last = max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=0)
    return (last, spark.read.parquet(f"{root}/heads/generation={last}").first().manifest_hash) if last else (0, None)


def members(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """(path, revision, first, last) of all members; last is null while a member is open."""
    upto = head(spark, root)[0] if upto is None else upto
    opened = _at(spark, root, "opened", "path string, revision string", upto).withColumnRenamed("generation", "first")
    closed = _at(spark, root, "closed", "path string, first int", upto).select("path", "first", (F.col("generation") - 1).alias("last"))
    return opened.join(closed, ["path", "first"], "left").select("path", "revision", "first", "last")


def at(spark: SparkSession, root: str, generation: int) -> DataFrame:
    """(path, revision) of a generation: a filter on ranges."""
    inside = (F.col("first") <= generation) & (F.col("last").isNull() | (F.col("last") >= generation))
    return members(spark, root, generation).filter(inside).select("path", "revision")


def parsed(spark: SparkSession, root: str, generation: int, schema: str) -> DataFrame:
    """What the parser made of the revisions of a generation: (path, revision, `schema`)."""
    made = _at(spark, root, "parsed", f"revision string, {schema}", generation).drop("generation")
    return at(spark, root, generation).join(made, "revision").select("path", "revision", *[c.split()[0] for c in schema.split(", ")])


def build(files: DataFrame, root: str, parse: Callable[[DataFrame], DataFrame], path: str = "path", revision: str = "content_hash", text: str = "text") -> tuple[int, bool]:
    """The generation of `files`, and if one had to be built: a manifest equal to the head's needs none.

    `parse` takes (revision, text) of the revisions that no generation has had and returns rows with `revision`. It reads the texts of no other file."""
    spark = files.sparkSession
    manifest = files.select(F.col(path).alias("path"), F.col(revision).alias("revision"))
    last, before = head(spark, root)
    now = manifest_hash(manifest, "path", "revision").first()[0]
    if now == before:
        return last, False
    this = last + 1
    current = members(spark, root, last).filter("last is null")
    write = lambda df, kind: df.write.mode("overwrite").parquet(f"{root}/{kind}/generation={this}")
    write(manifest.join(current, ["path", "revision"], "left_anti").distinct(), "opened")
    write(current.join(manifest, ["path", "revision"], "left_anti").select("path", "first"), "closed")
    known = _at(spark, root, "opened", "path string, revision string", last).select("revision").distinct()
    fresh = files.select(F.col(revision).alias("revision"), F.col(text).alias("text")).join(known, "revision", "left_anti")
    # Files with equal texts are parsed once.
    write(parse(fresh.groupBy("revision").agg(F.first("text").alias("text"))), "parsed")
    spark.createDataFrame([(now,)], "manifest_hash string").write.mode("overwrite").parquet(f"{root}/heads/generation={this}")
    return this, True


def difference(spark: SparkSession, root: str, one: int, two: int) -> DataFrame:
    """(path, was, now): paths whose revision differs between two generations; null where there is none. Members that both have are left out by their ranges."""
    both = members(spark, root, max(one, two))
    inside = lambda g: (F.col("first") <= g) & (F.col("last").isNull() | (F.col("last") >= g))
    either = both.filter(inside(one) != inside(two))
    out = either.groupBy("path").agg(F.max(F.when(inside(one), F.col("revision"))).alias("was"), F.max(F.when(inside(two), F.col("revision"))).alias("now"))
    return out.filter(~F.col("was").eqNullSafe(F.col("now")))


def switch(spark: SparkSession, root: str, target: str, to: int) -> int:
    """Brings the projection at `target` to a generation; returns how many paths changed. Its rows are a new folder, and the row that names it is written last: readers see the old
    generation or the new one whole."""
    was = projected(spark, target)
    if was is None:
        rows, changed = at(spark, root, to), None
    else:
        change = difference(spark, root, was[0], to)
        changed = change.count()
        if not changed and was[0] == to:
            return 0
        rows = was[1].join(change.select("path"), "path", "left_anti").unionByName(change.filter("now is not null").select("path", F.col("now").alias("revision")))
    step = (was[2] if was else 0) + 1
    rows.write.mode("overwrite").parquet(f"{target}/rows/step={step}")
    spark.createDataFrame([(to,)], "generation int").write.mode("overwrite").parquet(f"{target}/heads/generation={step}")
    return rows.count() if changed is None else changed


def projected(spark: SparkSession, target: str) -> tuple[int, DataFrame, int] | None:
    """(generation, rows, step) of a projection, or None before the first switch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/heads/generation=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    step = max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=0)
    if not step:
        return None
    return spark.read.parquet(f"{target}/heads/generation={step}").first().generation, spark.read.schema("path string, revision string").parquet(f"{target}/rows/step={step}"), step
