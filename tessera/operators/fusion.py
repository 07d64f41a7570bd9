"""Reciprocal rank fusion and the search pipeline on top of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import snippet
from tessera.operators.ledger import TERMINAL
from tessera.session import shared_dir

# The constant of the ranks and the depth that a lexical hit may displace.
RANK_CONSTANT, DISPLACEMENT = 60, 2
DENSE_WEIGHT = 1.0
# How many results a call gets unless it says so, and at most.
SEARCH_LIMIT, SEARCH_MOST = 10, 50
LEXICAL_WEIGHT = 1 - (RANK_CONSTANT + 1) / (RANK_CONSTANT + DISPLACEMENT)


def rrf(lexical: DataFrame, dense: DataFrame, limit: int | None = None, id: str = "doc_id", query: str = "query_id", weights: tuple[float, float] = (LEXICAL_WEIGHT, DENSE_WEIGHT), digits: int = 9) -> DataFrame:
    """(query, id, score, lexical_rank, dense_rank, rank): weights over 60 + rank, summed over the legs; ties to the smaller id."""
    a = lexical.select(query, id, F.col("rank").alias("lexical_rank"))
    b = dense.select(query, id, F.col("rank").alias("dense_rank"))
    part = lambda w, r: F.coalesce(F.lit(w) / (RANK_CONSTANT + F.col(r)), F.lit(0.0))
    fused = a.join(b, [query, id], "full_outer").withColumn("score", F.round(part(weights[0], "lexical_rank") + part(weights[1], "dense_rank"), digits))
    out = fused.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), F.asc(id))))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def search(lexical: DataFrame | None, dense: DataFrame | None, limit: int = SEARCH_LIMIT, mode: str = "hybrid", **names) -> tuple[DataFrame, str]:
    """The ranked ids and how the answer came about: hybrid, lexical_only or dense_only. Modes: hybrid, lexical, code. No call gets
    more than `SEARCH_MOST` of a query."""
    limit = min(limit, SEARCH_MOST)
    if mode not in ("hybrid", "lexical", "code"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "lexical":
        dense = None
    elif mode == "code":
        lexical = None
    if lexical is None and dense is None:
        raise RuntimeError("no leg can be searched")
    if lexical is None or dense is None:
        leg = lexical if dense is None else dense
        empty = leg.limit(0)
        out = rrf(leg, empty, limit, **names) if dense is None else rrf(empty, leg, limit, **names)
        return out, "lexical_only" if dense is None else "dense_only"
    return rrf(lexical, dense, limit, **names), "hybrid"


def enrich(hits: DataFrame, units: DataFrame, id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The hits with what is known of them, ranks kept, and the count of hits of which nothing is known."""
    return hits.join(units, id), hits.join(units.select(id), id, "left_anti").agg(F.count("*").alias("missing"))


def with_snippets(hits: DataFrame, text: str = "text", start: str = "start", end: str = "end") -> DataFrame:
    return hits.withColumn("snippet", snippet(F.col(text), F.col(start), F.col(end)))


def file_context(units: DataFrame, skipped: DataFrame, path: str) -> DataFrame:
    """All units of a path by (start, end, id); without any, one row with the reason that it isn't indexed."""
    found = units.filter(F.col("path") == path).select("path", "id", "start", "end", F.lit(None).cast("string").alias("reason"))
    why = skipped.filter(F.col("path") == path).select("path", F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "reason")
    return found.unionByName(why.join(found.select("path").distinct(), "path", "left_anti")).orderBy("start", "end", "id")


# ---- recall


def placed(rows: DataFrame, *order: Column, to: str = "rank") -> DataFrame:
    """The rows with their place in order over all of them, from 1, and without a task that sees them all: ranges are sorted side by side, and each counts on from the
    rows of the ranges before it."""
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession, "placed")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    at = spark.read.schema(rows.schema.add("_at", "long")).parquet(path)
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = at.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(to, F.col("_before") + F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + 1).drop("_at", "_part", "_before")


def recall(candidates: DataFrame, lexical: DataFrame, dense: DataFrame, budget: int, cost: Column, id: str = "entry_id", least: int = 8, fresh: DataFrame | None = None) -> DataFrame:
    """All candidates by (score, newest, id), unscored ones with 0, up to the first that would overflow the budget.

    An entry costs `least` at least, so no more than budget / least of them fit: the best of those many are found by a distributed
    top-k, and the running cost needs an order over them alone. `fresh`: the entries as they are now (id, state, text); candidates that are gone or in a closing
    state by now are passed over, and what an entry costs is what its text costs now.
    """
    fused = rrf_scores(lexical, dense, id)
    order = (F.desc("score"), F.desc("created_at"), F.asc(id))
    w = W.orderBy(*order)
    if fresh is not None:
        now = fresh.filter(~F.col("state").isin(*TERMINAL)).select(id, "text")
        candidates = candidates.drop("text").join(now, id)
    rows = candidates.join(fused, id, "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("cost", cost)
    best = rows.orderBy(*order).limit(budget // least + 1)
    return best.withColumn("spent", F.sum("cost").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(w)).filter(F.col("spent") <= budget)


def rrf_scores(lexical: DataFrame, dense: DataFrame, id: str, digits: int = 9) -> DataFrame:
    """(id, score) of one question's legs (id, rank), both with weight 1; nothing is ranked."""
    part = lambda r: F.coalesce(1.0 / (RANK_CONSTANT + F.col(r)), F.lit(0.0))
    both = lexical.select(id, F.col("rank").alias("_l")).join(dense.select(id, F.col("rank").alias("_d")), id, "full_outer")
    return both.select(id, F.round(part("_l") + part("_d"), digits).alias("score"))
