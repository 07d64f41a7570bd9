"""Content-addressed identities: SHA-256 over a domain and length-framed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def framed(domain: str, *fields: Column) -> Column:
    """`domain`, then each field as `bytes:value`, hashed. The lengths keep field borders apart; a null is framed as `-`."""
    parts = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.sha2(F.concat(F.lit(f"tessera/1/{domain}|"), *parts), 256)


def content_hash(content: Column) -> Column:
    """Plain SHA-256 of bytes or text."""
    return F.sha2(content.cast("binary"), 256)


def blob_id(algorithm: Column, language: Column, version: Column, text: Column) -> Column:
    return framed("content_blob", algorithm, language, version, text)


def occurrence_id(generation: Column, path: Column, unit: Column) -> Column:
    return framed("occurrence", generation, path, unit)


def path_fingerprint(path: Column) -> Column:
    return framed("path", path)


def remote_fingerprint(url: Column) -> Column:
    return framed("remote", url)


def signature_fingerprint(signature: Column) -> Column:
    return framed("signature", signature)


def coarse_seconds(time_ms: Column) -> Column:
    """Whole seconds, rounded down for times before 1970 too."""
    return F.floor(time_ms / 1000).cast("long")


def source_event_id(event: Column, session: Column, subject: Column, text: Column, time_ms: Column, occurrence: Column) -> Column:
    """What an event is told apart by. `subject`: the tool use or the agent; `text`: the prompt or the last message.

    Tool results and sub-agent stops name themselves; the others are told apart by their text's hash or kind and their second.
    """
    at = coarse_seconds(time_ms).cast("string")
    hashed = F.sha2(F.coalesce(text, F.lit("")), 256)
    join = lambda *parts: F.concat_ws(":", *[F.lit(x) if isinstance(x, str) else x for x in parts])
    return (
        F.when(event == "PostToolUse", join("pt", session, subject, "ok"))
        .when(event == "PostToolUseFailure", join("pt", session, subject, "fail"))
        .when((event == "SubagentStop") & occurrence.isNotNull(), join("ss", session, subject, occurrence.cast("string")))
        .when(event == "UserPromptSubmit", join("up", session, hashed, at))
        .when(event == "Stop", join("st", session, hashed, at))
        .when(event == "SessionStart", join("se", session, "start", at))
        .when(event == "SessionEnd", join("se", session, "end", at))
    )


def dedup_key(event: Column, source_event: Column) -> Column:
    """Only events that name themselves are exact duplicates of each other; the others have no key."""
    return F.when(event.isin("PostToolUse", "PostToolUseFailure", "SubagentStop"), source_event)


KEY_VERSION = "1"


def candidate_key(op: Column, target: Column, scope_kind: Column, scope_owner: Column, kind: Column, text: Column) -> Column:
    """Candidates are the same if they would do the same: creates by scope, kind and text, replacements by the old entry too, others by
    what they act on."""
    hashed = F.sha2(F.coalesce(text, F.lit("")), 256)
    s = lambda c: c.cast("string")
    return F.concat_ws(
        "|", F.lit(KEY_VERSION),
        F.when(op == "create", F.concat_ws("|", op, scope_kind, s(scope_owner), kind, hashed))
        .when(op == "supersede", F.concat_ws("|", op, s(target), scope_kind, s(scope_owner), kind, hashed))
        .otherwise(F.concat_ws("|", op, s(target))),
    )
