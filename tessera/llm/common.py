"""Expressions and small helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Java and DuckDB regular expressions for what separates words.
SPACES = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case and nothing else; texts of ASCII alone take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column, separators: str = SPACES) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def ngram_hashes(words: Column, size: int) -> Column:
    """A 64-bit hash for each run of `size` words; fewer words: an empty array."""
    n = F.size(words)
    return F.when(
        n >= size,
        F.transform(
            F.sequence(F.lit(1), n - (size - 1)),
            lambda i: F.xxhash64(*[F.element_at(words, (i + k).cast("int")) for k in range(size)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have: `name`, with as many underscores in front as it takes."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def barred(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, which no filter or projection passes.

    Without it the optimizer puts an array that is used once into the lambda that reads it, and a filter on a result below the
    projections that lead to it, and either splits and hashes the text again for every element.
    """
    return df.select(F.explode_outer(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("r")).select("r.*")


def root_dir(spark: SparkSession) -> str:
    """This application's folder under the one that all executors share; a local session that names none gets one under /tmp."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not root and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or '/tmp/checkpoints').rstrip('/')}/{context.applicationId}"


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage, survives lost executors. `release` removes them."""
    spark = df.sparkSession
    path = f"{root_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Removes everything that this application's operators wrote; results that are not stored yet cannot be read afterwards."""
    _delete(spark, root_dir(spark))


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that `written` made."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Keeps the Arrow batches of this session small, so that a task holds few texts at a time, however long they are.

    Sets session options that are there for it; smaller values that a session has already stay.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        if key.endswith("RecordsPerBatch") and now is not None and 0 < int(now) <= rows:
            continue
        spark.conf.set(key, str(value))


def tidy(spark: SparkSession) -> None:
    """Shuffle files go when the query that wrote them has ended, instead of when the driver collects its garbage: for what runs many queries.

    Sets a session option; queries that read one DataFrame several times through shuffles write them again."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
