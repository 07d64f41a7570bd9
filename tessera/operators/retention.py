"""What may be deleted: pinned generations, sweeps, budgets and expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.session import shared_dir

HOUR = 3_600_000
# Lifetimes in milliseconds.
LIFETIMES = {"candidate": 30 * 24 * HOUR, "session": 14 * 24 * HOUR, "shard": 7 * 24 * HOUR, "payload": 72 * HOUR}


def pinned(generations: DataFrame, now_ms: int, keep: int = 2, hours: int = 168, external: DataFrame | None = None, leases: DataFrame | None = None) -> DataFrame:
    """Ids that stay: unfinished, ready and active ones, the last `keep` retiring ones of a worktree, young ones, pins from outside, and
    those with a lease (generation_id, lease_until) that still runs."""
    w = W.partitionBy("worktree_id", F.col("state") == "retiring").orderBy(F.desc("number"), F.asc("generation_id"))
    ranked = generations.withColumn("_n", F.row_number().over(w))
    stays = F.col("state").isin("building", "projection_ready", "active") | ((F.col("state") == "retiring") & ((F.col("_n") <= keep) | (now_ms - F.col("created_at") <= hours * HOUR)))
    out = ranked.filter(stays).select("generation_id")
    for more in (external, None if leases is None else leases.filter(F.col("lease_until") > now_ms)):
        out = out if more is None else out.unionByName(more.select("generation_id"))
    return out.distinct()


# The tables that a sweep deletes from, children before their parents, and the key that ties each to what stays.
PHASES = (
    ("edge", "generation_id"), ("occurrence", "generation_id"), ("file", "generation_id"), ("skipped", "generation_id"), ("generation", "generation_id"),
    ("reference", "revision_id"), ("unit", "revision_id"), ("revision", "revision_id"), ("blob", "blob_id"),
)
BATCH_ROWS = 500


def sweepable(tables: dict[str, DataFrame], pins: DataFrame) -> dict[str, DataFrame]:
    """The rows that a sweep deletes from each table, in order of the phases.

    Members of a generation go with it. Revisions go that no file of a generation that stays names, with their references and units;
    blobs go that no revision that stays names. `tables`: edge, occurrence, file (generation_id, revision_id), skipped and generation with a
    generation_id; reference, unit and revision (revision_id, blob_id) with a revision_id; blob with a blob_id. Absent tables have no phase.
    """
    stays = {"generation_id": pins.select("generation_id").distinct()}
    if "file" in tables:
        stays["revision_id"] = tables["file"].join(stays["generation_id"], "generation_id", "left_semi").select("revision_id").distinct()
    if "revision" in tables and "revision_id" in stays:
        stays["blob_id"] = tables["revision"].join(stays["revision_id"], "revision_id", "left_semi").select("blob_id").distinct()
    return {name: tables[name].join(stays[key], key, "left_anti") for name, key in PHASES if name in tables and key in stays}


def sweep_plan(tables: dict[str, DataFrame], pins: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """(position, phase, rows, batches): what a sweep would delete, in its order; nothing is deleted."""
    out = None
    for name, gone in sweepable(tables, pins).items():
        position = [p[0] for p in PHASES].index(name)
        row = gone.agg(F.lit(position).alias("position"), F.lit(name).alias("phase"), F.count("*").alias("rows")).withColumn("batches", F.ceil(F.col("rows") / batch_rows).cast("long"))
        out = row if out is None else out.unionByName(row)
    return out


def switch_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): what changes from the old generation to the new one: add, remove or replace."""
    a, b = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_in_old")), new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "add").when(F.col("_in_new").isNull(), "remove").when(~F.col("_old").eqNullSafe(F.col("_new")), "replace")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def sweep(table: DataFrame, pins: DataFrame) -> DataFrame:
    """The rows that stay."""
    return table.join(pins, "generation_id", "left_semi")


def evict(cache: DataFrame, budget: int, pins: DataFrame | None = None, key: str = "key", size: str = "bytes", used: str = "last_used") -> DataFrame:
    """The least recently used rows that are not pinned, until the rest fits the budget.

    The walk is one running sum over the whole cache, so it is done in two steps: sums of sorted ranges first, then the running sum within a
    range. Ranges are cut by time and key, so that rows of one time are dealt over as many tasks as they need.
    """
    over = max(0, (cache.agg(F.sum(size)).first()[0] or 0) - budget)
    free = cache if pins is None else cache.join(pins.select(key).distinct(), key, "left_anti")
    if not over:
        return cache.limit(0)
    spark, path = cache.sparkSession, shared_dir(cache.sparkSession, "ranges")
    free.repartitionByRange(used, key).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.schema(free.schema.add("_part", "integer")).parquet(path)
    sums = rows.groupBy("_part").agg(F.sum(size).alias("_sum"))  # a row for each range
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    w = W.partitionBy("_part").orderBy(used, key).rowsBetween(W.unboundedPreceding, -1)
    walk = rows.join(F.broadcast(before), "_part").withColumn("_freed", F.col("_before") + F.coalesce(F.sum(size).over(w), F.lit(0)))
    return walk.filter(F.col("_freed") < over).select(*cache.columns)


def expired(rows: DataFrame, at: str, what: str, now_ms: int) -> DataFrame:
    return rows.filter(F.lit(now_ms) - F.col(at) >= LIFETIMES[what])


def expire_payloads(envelopes: DataFrame, now_ms: int, imported: str = "imported_at", payload: str = "payload") -> DataFrame:
    """Payloads that are due become null; their envelopes stay."""
    return envelopes.withColumn(payload, F.when(F.col(imported) + LIFETIMES["payload"] > now_ms, F.col(payload)))


def superseded_builds(generations: DataFrame) -> DataFrame:
    """Unserved generations that a newer active one has overtaken: they fail."""
    w = W.partitionBy("worktree_id")
    top = F.max(F.when(F.col("state") == "active", F.col("number"))).over(w)
    return generations.withColumn("_top", top).filter(F.col("state").isin("building", "projection_ready") & (F.col("number") < F.col("_top"))).drop("_top")


def stuck_generations(generations: DataFrame) -> DataFrame:
    """Unserved generations that are newer than the active one."""
    top = F.max(F.when(F.col("state") == "active", F.col("number"))).over(W.partitionBy("worktree_id"))
    return generations.withColumn("active_number", top).filter(F.col("state").isin("building", "projection_ready", "failed") & (F.col("number") > F.coalesce("active_number", F.lit(-1))))
