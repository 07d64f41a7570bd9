"""Retrieval and routing quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranks(hits: DataFrame, relevant: DataFrame, query: str = "query_id", id: str = "doc_id") -> DataFrame:
    """(query, rank): the best rank of a relevant hit, null without one; every query that has something relevant."""
    good = hits.join(relevant, [query, id]).groupBy(query).agg(F.min("rank").alias("rank"))
    return relevant.select(query).distinct().join(good, query, "left")


def retrieval(ranked: DataFrame, *by: str, digits: int = 6) -> DataFrame:
    """hit@1, 3 and 5, MRR and recall@5 (one relevant target), with the number of queries, for each group."""
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), digits)
    return ranked.groupBy(*by).agg(
        F.count("*").alias("queries"), hit(1).alias("hit_1"), hit(3).alias("hit_3"), hit(5).alias("hit_5"),
        F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), digits).alias("mrr"), hit(5).alias("recall_5"),
    )


def routing(expected: DataFrame, predicted: DataFrame, case: str = "case_id", kind: str = "kind", digits: int = 6) -> DataFrame:
    """One row: micro precision, recall and F1 over multisets of kinds, and the share of cases that match exactly."""
    e = expected.groupBy(case, kind).agg(F.count("*").alias("e"))
    p = predicted.groupBy(case, kind).agg(F.count("*").alias("p"))
    both = e.join(p, [case, kind], "full_outer").withColumn("e", F.coalesce("e", F.lit(0))).withColumn("p", F.coalesce("p", F.lit(0)))
    cases = both.groupBy(case).agg(F.sum("e").alias("e"), F.sum("p").alias("p"), F.sum(F.least("e", "p")).alias("tp"), F.min((F.col("e") == F.col("p")).cast("int")).alias("exact"))
    t = cases.agg(F.sum("tp").alias("tp"), F.sum("e").alias("e"), F.sum("p").alias("p"), F.avg("exact").alias("exact"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    precision, recall = ratio(F.col("tp"), F.col("p")), ratio(F.col("tp"), F.col("e"))
    return t.select(
        F.round(precision, digits).alias("precision"), F.round(recall, digits).alias("recall"),
        F.round(ratio(2 * F.col("tp"), F.col("e") + F.col("p")), digits).alias("f1"), F.round("exact", digits).alias("exact_match"),
    )


def gated(value: Column, baseline: Column, tolerance: Column) -> Column:
    """As `gate`, over columns."""
    return F.round((baseline - value) * 1e4) <= F.round(tolerance * 1e4)


def gate(value: float, baseline: float, tolerance: float) -> bool:
    """Compared in ten thousandths, so that what prints equal is equal."""
    return round((baseline - value) * 1e4) <= round(tolerance * 1e4)
