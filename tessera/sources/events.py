"""Observation envelopes from event files and hook payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Event types with what they are evidence of and how far they are trusted, and the tool inputs that hold paths.
EVIDENCE = {
    "PostToolUse": ("tool_result", "normal"), "PostToolUseFailure": ("tool_result", "normal"), "UserPromptSubmit": ("user_statement", "high"),
    "Stop": ("model_claim", "low"), "SubagentStop": ("model_claim", "low"), "SessionStart": ("code_state", "normal"), "SessionEnd": ("code_state", "normal"),
}
EVENTS = tuple(EVIDENCE)
PATH_KEYS = ("file_path", "path", "notebook_path")
HOOK = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("hook_event_name", T.StringType()), T.StructField("cwd", T.StringType()), T.StructField("tool_name", T.StringType()), T.StructField("tool_use_id", T.StringType()), T.StructField("tool_input", T.StringType()), T.StructField("prompt", T.StringType())])


def read_spool(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good and corrupt lines of JSON-lines segments; a torn last line is a corrupt one."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).cache()
    return rows.filter("_corrupt_record is null").drop("_corrupt_record"), rows.filter("_corrupt_record is not null").select("_corrupt_record")


def parse_hook(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Events, and the rejected payloads with the reason."""
    e = F.from_json(column, HOOK)
    rows = raw.withColumn("_e", e)
    reason = (
        F.when(F.col("_e").isNull() | (F.col("_e.session_id").isNull() & F.col("_e.hook_event_name").isNull() & ~F.trim(column).startswith("{")), "no json object")
        .when(F.coalesce(F.col("_e.session_id"), F.lit("")) == "", "no session_id")
        .when(F.coalesce(F.col("_e.hook_event_name"), F.lit("")) == "", "no hook_event_name")
        .when(~F.col("_e.hook_event_name").isin(*EVENTS), "unknown event")
    )
    rows = rows.withColumn("_reason", reason)
    return rows.filter("_reason is null").select("_e.*"), rows.filter("_reason is not null").select(column, F.col("_reason").alias("reason"))


def input_paths(tool_input: Column) -> Column:
    """The paths that a tool was given, in the order of the keys."""
    found = F.array(*[F.get_json_object(tool_input, f"$.{k}") for k in PATH_KEYS])
    return F.filter(found, lambda p: p.isNotNull() & (p != ""))


def evidence_kind(event: Column) -> Column:
    """Null for unknown events."""
    return _of(event, 0)


def trust(event: Column) -> Column:
    return _of(event, 1)


def _of(event: Column, place: int) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in EVIDENCE.items() for x in (k, v[place])]), event)
