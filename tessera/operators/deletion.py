"""Deletions from stored tables: partitions by a hash of the owner, of which only those that lose rows are written, in phases that can be resumed.

Under a root: `<table>/bucket=<n>`, and `_deletions/<id>/` with `ids/step=<n>`, what goes in each step, `plan`, written last of these, and `done/step=<n>`. What goes is
found once, before anything does; a step takes rows away and so may run twice. A deletion that was cut off after any step is finished by the next
call. Children come before their parents, so that nothing ever names a row that is gone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ledger, retention

BUCKETS = 64


def _paths(spark: SparkSession, pattern: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [f.getPath() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []]


def store(rows: DataFrame, root: str, name: str, owner: str, buckets: int = BUCKETS) -> None:
    """Writes a table anew. An owner's rows are in one partition; `repartition` deals a partition over tasks by all columns, so that a large owner isn't one task's."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(owner), F.lit(buckets)).cast("int"))
    rows.limit(0).write.mode("overwrite").parquet(f"{root}/_schemas/{name}")
    dealt.repartition("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(4))).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{name}")


def _stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table with its `bucket`; its columns are known even when it has no files left."""
    schema = spark.read.parquet(f"{root}/_schemas/{name}").schema.add("bucket", "integer")
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return _stored(spark, root, name).drop("bucket")


def remove(spark: SparkSession, root: str, name: str, key: str, ids: DataFrame) -> list[int]:
    """Deletes the rows whose key is in `ids`; returns the partitions that were written. The others keep their files."""
    table = _stored(spark, root, name)
    hit = table.select(key, "bucket").join(ids.select(key), key, "left_semi").select("bucket").distinct()
    touched = sorted(r.bucket for r in hit.collect())  # numbers of partitions
    if not touched:
        return []
    kept = table.filter(F.col("bucket").isin(touched)).join(ids.select(key), key, "left_anti").select(*table.columns)
    left = {r.bucket for r in kept.select("bucket").distinct().collect()}
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/{name}")
    for bucket in set(touched) - left:  # an overwrite leaves partitions alone that it has no rows for
        for path in _paths(spark, f"{root}/{name}/bucket={bucket}"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return touched


def begin(spark: SparkSession, root: str, steps: list[tuple[str, str, DataFrame]]) -> str:
    """Writes down what goes: (table, key, ids) in order."""
    folder = f"{root}/_deletions/{uuid.uuid4().hex}"
    for n, (_, key, ids) in enumerate(steps):
        ids.select(key).distinct().write.parquet(f"{folder}/ids/step={n}")
    plan = [(n, table, key) for n, (table, key, _) in enumerate(steps)]
    spark.createDataFrame(plan, "step int, table string, key string").coalesce(1).write.parquet(f"{folder}/plan")
    return folder


def resume(spark: SparkSession, root: str, steps: int | None = None) -> list[tuple[str, list[int]]]:
    """Finishes the deletions that have begun; returns (table, partitions written) of each step. `steps`: no more than so many, as if cut off."""
    out: list[tuple[str, list[int]]] = []
    for marker in _paths(spark, f"{root}/_deletions/*/plan/_SUCCESS"):
        folder = marker.getParent().getParent().toString()
        plan = sorted(spark.read.parquet(f"{folder}/plan").collect())
        done = {int(p.getParent().getName().split("=")[1]) for p in _paths(spark, f"{folder}/done/step=*/_SUCCESS")}
        for step, table, key in plan:
            if step in done:
                continue
            if steps is not None and len(out) >= steps:
                return out
            out.append((table, remove(spark, root, table, key, spark.read.parquet(f"{folder}/ids/step={step}"))))
            spark.createDataFrame([(step,)], "step int").write.mode("overwrite").parquet(f"{folder}/done/step={step}")
        finished = marker.getParent().getParent()
        finished.getFileSystem(spark._jsc.hadoopConfiguration()).delete(finished, True)
    return out


def sweep(spark: SparkSession, root: str, tables: list[str], pins: DataFrame, steps: int | None = None) -> list[tuple[str, list[int]]]:
    """Deletes from the stored tables what `retention.sweepable` says, in its nine phases. A sweep that had begun is finished first."""
    before = resume(spark, root, steps)
    if steps is not None and len(before) >= steps:
        return before
    found = {name: read(spark, root, name) for name in tables}
    keys = dict(retention.PHASES)
    gone = retention.sweepable(found, pins)
    begin(spark, root, [(name, keys[name], rows) for name, rows in gone.items()])
    return before + resume(spark, root, None if steps is None else steps - len(before))


def purge_session(spark: SparkSession, root: str, session: object, steps: int | None = None) -> list[tuple[str, list[int]]]:
    """Deletes a session from the stored `entries`, `evidence` and `envelopes`: evidence that rests on it, entries that have none left, and last its envelopes."""
    before = resume(spark, root, steps)
    if steps is not None and len(before) >= steps:
        return before
    entries, evidence, envelopes = (read(spark, root, name) for name in ("entries", "evidence", "envelopes"))
    left = ledger.purge_session(entries, evidence, envelopes, session)
    events = envelopes.filter(F.col("session_id") == F.lit(session)).select("event_id")
    orphans = entries.select("entry_id").join(left[0].select("entry_id"), "entry_id", "left_anti")
    begin(spark, root, [("evidence", "event_id", events), ("evidence", "entry_id", orphans), ("entries", "entry_id", orphans), ("envelopes", "event_id", events)])
    return before + resume(spark, root, None if steps is None else steps - len(before))
