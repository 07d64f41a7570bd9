"""The engine's entities derived from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

EXTENSIONS = ("md", "py", "json", "rs", "txt")
KINDS = ("fact", "decision", "task", "question", "hypothesis", "convention", "procedure")
STATES = ("active", "active", "resolved", "superseded", "confirmed")
NOW = 1_710_000_000_000


def pick(values: tuple[str, ...], by):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by + 1).cast("int"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: id, path, text, source, lang, generation and worktree."""
    x = table(spark, d, "documents")
    return x.select(
        F.col("doc_id"), F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id"), F.lit("."), pick(EXTENSIONS, F.col("doc_id") % 5))).alias("path"),
        "text", "source", "lang", F.concat(F.lit("g"), F.col("doc_id") % 3).alias("generation_id"), F.concat(F.lit("w"), F.col("doc_id") % 2).alias("worktree_id"),
    )


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Events as envelopes: session, sequence, time, type, source event and excerpt."""
    x = table(spark, d, "events")
    return x.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("received_seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
        F.col("event_type"), F.concat_ws(":", "event_type", (F.col("event_id") % 7).cast("string")).alias("source_event_id"), F.col("props").alias("excerpt"),
    )


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as entries."""
    x = table(spark, d, "conversations")
    c, t = F.col("conv_id"), F.col("turn")
    return x.select(
        (c * 1000 + t).alias("entry_id"), pick(("global", "repo", "worktree"), c % 3).alias("scope_kind"), (c % 5).alias("scope_owner"), pick(KINDS, t % 7).alias("kind"),
        pick(STATES, (c + t) % 5).alias("state"), (c * 100 + t).alias("created_at"), F.col("text"), F.col("role"), c.alias("conv_id"), t.alias("turn"),
        (t % 4 + 1).cast("bigint").alias("entry_version"), ((c * 7 + t) % 10 / 10.0).cast("double").alias("confidence"), F.when((c + t) % 2 == 0, F.concat(F.lit("k"), c % 10)).alias("canonical_key"),
    )


SQL = {
    "files": """files AS (SELECT doc_id, source || '/' || lang || '/d' || doc_id || '.' || (['md','py','json','rs','txt'])[CAST(doc_id % 5 AS INTEGER) + 1] AS path, text, source, lang, 'g' || (doc_id % 3) AS generation_id, 'w' || (doc_id % 2) AS worktree_id FROM documents)""",
    "obs": """obs AS (SELECT user_id AS session_id, event_id AS received_seq, epoch_us(ts) // 1000 AS at_ms, event_type, event_type || ':' || (event_id % 7) AS source_event_id, props AS excerpt FROM events)""",
    "mem": """mem AS (SELECT conv_id * 1000 + turn AS entry_id, (['global','repo','worktree'])[CAST(conv_id % 3 AS INTEGER) + 1] AS scope_kind, conv_id % 5 AS scope_owner,
  (['fact','decision','task','question','hypothesis','convention','procedure'])[CAST(turn % 7 AS INTEGER) + 1] AS kind, (['active','active','resolved','superseded','confirmed'])[CAST((conv_id + turn) % 5 AS INTEGER) + 1] AS state,
  conv_id * 100 + turn AS created_at, text, role, conv_id, turn, CAST(turn % 4 + 1 AS BIGINT) AS entry_version, CAST((conv_id * 7 + turn) % 10 AS DOUBLE) / 10.0 AS confidence, CASE WHEN (conv_id + turn) % 2 = 0 THEN 'k' || (conv_id % 10) END AS canonical_key FROM conversations)""",
}


def with_(*names: str, rest: str = "") -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + (", " + rest if rest else "") + "\n"
