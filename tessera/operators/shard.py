"""Vector shards: points in order of their ids over files whose ranges are known, and a head that says what must be in them.

Under a root: `points/` (id, embedding), `files/` (file, low, high), and `head/`, one row, written last. Lookups open the files whose ranges hold an id that is asked for and no
others. `validate` compares the head with what is expected and what is there and names the first difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import manifest_hash

FORMAT = 1
#: Points in a file, about.
FILE = 50_000
HEAD = "generation string, format_version int, dims int, points long, digest string"


def _head(df: DataFrame, root: str) -> None:
    df.coalesce(1).write.mode("overwrite").parquet(f"{root}/head")


def write(points: DataFrame, root: str, dims: int, generation: str, id: str = "vec_id", vector: str = "embedding", per_file: int = FILE) -> None:
    """Raises where a vector has another dimension or an id comes twice."""
    spark = points.sparkSession
    rows = points.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("embedding"))
    seen = rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count(F.when(F.coalesce(F.size("embedding"), F.lit(-1)) != dims, 1)).alias("bad")).first()
    if seen.ids != seen.n or seen.bad:
        raise ValueError(f"{seen.n} points have {seen.ids} ids, and {seen.bad} have not {dims} dimensions")
    parts = max(1, -(-seen.n // per_file))
    rows.repartitionByRange(parts, "id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{root}/points")
    stored = spark.read.parquet(f"{root}/points").select("id", F.col("_metadata.file_path").alias("file"))
    stored.groupBy("file").agg(F.min("id").alias("low"), F.max("id").alias("high")).coalesce(1).write.mode("overwrite").parquet(f"{root}/files")
    digest = manifest_hash(rows, "id").select(F.col("manifest_hash").alias("digest"))
    _head(digest.select(F.lit(generation).alias("generation"), F.lit(FORMAT).alias("format_version"), F.lit(dims).alias("dims"), F.lit(seen.n).cast("long").alias("points"), "digest"), root)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def validate(spark: SparkSession, root: str, dims: int, generation: str, strong: bool = True) -> str | None:
    """None, or the first of: missing_head, generation, format_version, dims, count, and, where `strong`, vectors and digest, which read the points."""
    if not _exists(spark, f"{root}/head/_SUCCESS"):
        return "missing_head"
    head = spark.read.schema(HEAD).parquet(f"{root}/head").first()
    for name, want in (("generation", generation), ("format_version", FORMAT), ("dims", dims)):
        if head[name] != want:
            return name
    points = spark.read.schema("id bigint, embedding array<float>").parquet(f"{root}/points")
    if points.count() != head.points:  # from the files' footers
        return "count"
    if not strong:
        return None
    if points.filter(F.coalesce(F.size("embedding"), F.lit(-1)) != dims).limit(1).count():
        return "vectors"
    return None if manifest_hash(points, "id").first()[0] == head.digest and points.select("id").distinct().count() == head.points else "digest"


def holding(spark: SparkSession, root: str, ids: DataFrame, id: str = "vec_id") -> list[str]:
    """The files whose ranges hold an id of `ids`: a name for each, at most as many as the shard has."""
    ranges = spark.read.parquet(f"{root}/files")
    # A file's range is one row, so each id is compared with the ranges of a small table.
    asked = ids.select(F.col(id).cast("bigint").alias("id")).distinct()
    found = asked.join(F.broadcast(ranges), (F.col("id") >= F.col("low")) & (F.col("id") <= F.col("high")))
    return sorted(r.file for r in found.select("file").distinct().collect())


def lookup(spark: SparkSession, root: str, ids: DataFrame, id: str = "vec_id") -> DataFrame:
    """(id, embedding) of the ids that the shard has."""
    files = holding(spark, root, ids, id)
    schema = "id bigint, embedding array<float>"
    points = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return points.join(ids.select(F.col(id).cast("bigint").alias("id")).distinct(), "id", "left_semi").withColumnRenamed("id", id)
