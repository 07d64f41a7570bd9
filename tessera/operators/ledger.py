"""The entry store: states, operations, candidates, consolidation windows and purges, as functions from tables to tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.stats import range_counts

TERMINAL = ("resolved", "retracted", "rejected", "superseded")
# The legal transitions of each state machine; staying in a state is always legal.
TRANSITIONS = {
    "generation": "building>projection_ready building>failed projection_ready>active projection_ready>failed active>retiring",
    "model_space": "building>projection_ready building>failed projection_ready>active projection_ready>failed active>retiring",
    "worktree": "active>detached detached>active active>removing detached>removing",
    "projection": "clean>updating updating>clean clean>dirty updating>dirty dirty>rebuilding rebuilding>clean rebuilding>dirty",
    "run": "pending>running running>applied running>failed failed>running",
    "candidate": "pending>approved pending>rejected pending>expired",
    "task": "active>resolved active>retracted",
    "question": "active>resolved active>retracted",
    "hypothesis": "active>confirmed active>rejected active>superseded confirmed>superseded",
    "fact": "active>superseded active>retracted",
    "decision": "active>superseded active>retracted",
    "convention": "active>superseded active>retracted",
    "procedure": "active>superseded active>retracted",
}
KINDS = ("task", "question", "hypothesis", "fact", "decision", "convention", "procedure")
STATE_OF = {"resolve": "resolved", "retract": "retracted", "confirm": "confirmed", "reject": "rejected"}


def transitions(spark: SparkSession) -> DataFrame:
    rows = [(m, *edge.split(">")) for m, edges in TRANSITIONS.items() for edge in edges.split()]
    return spark.createDataFrame(rows, "machine string, from_state string, to_state string")


def illegal(changes: DataFrame) -> DataFrame:
    """The (machine, from_state, to_state) rows that are no legal transition."""
    legal = F.broadcast(transitions(changes.sparkSession))  # a fixed table
    return changes.filter("from_state <> to_state").join(legal, ["machine", "from_state", "to_state"], "left_anti")


def in_scope(entries: DataFrame, kind: str, owner, canonical_key: str | None = None, live_only: bool = True) -> DataFrame:
    """Entries of a scope that are in no closing state; a key filter only where one is given."""
    out = entries.filter((F.col("scope_kind") == kind) & (F.col("scope_owner") == owner))
    if live_only:
        out = out.filter(~F.col("state").isin(*TERMINAL))
    return out if canonical_key is None else out.filter(F.col("canonical_key") == canonical_key)


#: Entries in a prompt at most, and what they may cost.
PROMPT_ENTRIES, PROMPT_BUDGET = 50, 12_000


def conflict_set(entries: DataFrame, hits: DataFrame, kind: str, owner, pending: DataFrame | None = None, limit: int = PROMPT_ENTRIES, budget: int = PROMPT_BUDGET) -> DataFrame:
    """(entry_id, n, spent): live entries of a scope that a new one may conflict with, those of `hits` (entry_id, rank) first, by their rank, then the newest; at most `limit`, as
    long as they fit the budget. `pending`: entries that an earlier operation of the same plan makes; they count as entries."""
    from tessera.functions.text import token_estimate

    here = in_scope(entries, kind, owner)
    if pending is not None:
        here = here.unionByName(in_scope(pending, kind, owner).select(*here.columns))
    order = (F.col("rank").isNull(), F.col("rank"), F.desc("created_at"), F.desc("entry_id"))
    best = here.join(hits.select("entry_id", "rank"), "entry_id", "left").orderBy(*order).limit(limit)
    w = W.orderBy(*order)  # over `limit` rows
    rows = best.withColumn("n", F.row_number().over(w)).withColumn("spent", F.sum(token_estimate(F.col("text"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.filter(F.col("spent") <= budget).select("entry_id", "n", "spent")


def scopes_union(entries: DataFrame, scopes: list[tuple[str, object]], id: str = "entry_id", cap: int = 20_000) -> DataFrame:
    """Entries of all scopes, each once, at most `cap` by id: the cap is the feature."""
    out = None
    for kind, owner in scopes:
        part = in_scope(entries, kind, owner)
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates([id]).orderBy(id).limit(cap)


# ---- operations


def create(entries: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """New rows whose idempotency key and, within their scope, canonical key are not taken, neither by entries nor by rows before them in order of
    the id; version 1, active."""
    replay = entries.select("idempotency_key").filter("idempotency_key is not null")
    taken = entries.filter(~F.col("state").isin(*TERMINAL) & F.col("canonical_key").isNotNull()).select("scope_kind", "scope_owner", "canonical_key").distinct()
    first = W.partitionBy("idempotency_key").orderBy("entry_id")
    fresh = new.withColumn("_nth", F.when(F.col("idempotency_key").isNull(), 1).otherwise(F.row_number().over(first))).filter("_nth = 1").drop("_nth")
    fresh = fresh.filter(~((F.col("kind").isin("fact", "decision", "convention", "procedure")) & (F.col("evidence_kind") == "model_claim")))
    rows = fresh.join(replay, "idempotency_key", "left_anti").join(taken, ["scope_kind", "scope_owner", "canonical_key"], "left_anti")
    owner = F.row_number().over(W.partitionBy("scope_kind", "scope_owner", "canonical_key").orderBy("entry_id"))
    keyed = rows.filter("canonical_key is not null").withColumn("_nth", owner).filter("_nth = 1").drop("_nth")
    rows = keyed.unionByName(rows.filter("canonical_key is null"))
    return rows.withColumn("state", F.lit("active")).withColumn("entry_version", F.lit(1).cast("long")).withColumn("updated_at", now)


def reinforce(entries: DataFrame, ops: DataFrame) -> DataFrame:
    """(entry_id, confidence, entry_version) of entries whose version is the expected one; a null confidence keeps the old."""
    o = ops.select("entry_id", "expected_version", F.col("confidence").alias("_new"))
    return entries.join(o, "entry_id").filter("entry_version = expected_version").select("entry_id", F.coalesce("_new", "confidence").alias("confidence"), (F.col("entry_version") + 1).alias("entry_version"))


def change_state(entries: DataFrame, ops: DataFrame) -> DataFrame:
    """resolve, retract, confirm and reject: (entry_id, op, from_state, to_state, entry_version, outcome)."""
    to = F.element_at(F.create_map(*[F.lit(x) for kv in STATE_OF.items() for x in kv]), F.col("op"))
    rows = entries.join(ops.select("entry_id", "op", "expected_version"), "entry_id").withColumn("to_state", to)
    legal = F.broadcast(transitions(entries.sparkSession).select(F.col("machine").alias("kind"), F.col("from_state").alias("state"), "to_state", F.lit(True).alias("legal")))
    rows = rows.join(legal, ["kind", "state", "to_state"], "left")
    outcome = F.when(F.col("entry_version") != F.col("expected_version"), "version_conflict").when(F.col("state") == F.col("to_state"), "unchanged").when(F.col("legal"), "applied").otherwise("illegal")
    rows = rows.withColumn("outcome", outcome)
    return rows.select("entry_id", "op", F.col("state").alias("from_state"), "to_state", (F.col("entry_version") + F.when(F.col("outcome") == "applied", 1).otherwise(0)).alias("entry_version"), "outcome")


def supersede(entries: DataFrame, ops: DataFrame) -> DataFrame:
    """Both rows of each replacement: the old one closed, and the new one in its scope that names it."""
    rows = entries.join(ops.select("entry_id", "new_id", "new_text"), "entry_id").filter(~F.col("state").isin(*TERMINAL))
    old = rows.select("entry_id", F.lit("superseded").alias("state"), (F.col("entry_version") + 1).alias("entry_version"), F.lit(None).cast("long").alias("supersedes_id"), "text", "scope_kind", "scope_owner")
    new = rows.select(F.col("new_id").alias("entry_id"), F.lit("active").alias("state"), F.lit(1).cast("long").alias("entry_version"), F.col("entry_id").alias("supersedes_id"), F.col("new_text").alias("text"), "scope_kind", "scope_owner")
    return old.unionByName(new)


def edit(entries: DataFrame, ops: DataFrame) -> DataFrame:
    """Text and importance where given; entries in a closing state are left out. `text_changed`: the normalised text must go."""
    o = ops.select("entry_id", F.col("text").alias("_text"), F.col("importance").alias("_importance"))
    rows = entries.join(o, "entry_id").filter(~F.col("state").isin(*TERMINAL))
    changed = F.col("_text").isNotNull() & (F.col("_text") != F.col("text"))
    return rows.select("entry_id", F.coalesce("_text", "text").alias("text"), F.coalesce("_importance", "importance").alias("importance"), (F.col("entry_version") + 1).alias("entry_version"), changed.alias("text_changed"))


def merge(entries: DataFrame, evidence: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`ops`: (survivor_id, loser_id). Losers of the survivor's scope close and name it, the survivor's version grows once, and it
    gets the evidence that it lacks."""
    e = entries.select("entry_id", "scope_kind", "scope_owner", "state", "entry_version")
    s = e.select(F.col("entry_id").alias("survivor_id"), "scope_kind", "scope_owner")
    losers = ops.join(e, ops["loser_id"] == e["entry_id"]).drop("entry_id").join(s, ["survivor_id", "scope_kind", "scope_owner"]).filter(~F.col("state").isin(*TERMINAL) & (F.col("loser_id") != F.col("survivor_id")))
    closed = losers.select(F.col("loser_id").alias("entry_id"), F.lit("superseded").alias("state"), (F.col("entry_version") + 1).alias("entry_version"), F.col("survivor_id").alias("superseded_by"))
    grown = losers.select("survivor_id").distinct().join(e, F.col("survivor_id") == F.col("entry_id")).select("entry_id", "state", (F.col("entry_version") + 1).alias("entry_version"), F.lit(None).cast("long").alias("superseded_by"))
    moved = evidence.join(losers.select("survivor_id", "loser_id"), evidence["entry_id"] == F.col("loser_id")).select(F.col("survivor_id").alias("entry_id"), "event_id").distinct()
    return closed.unionByName(grown), moved.join(evidence.select("entry_id", "event_id"), ["entry_id", "event_id"], "left_anti")


def audit(changes: DataFrame, id: str = "entry_id", order: str = "at", seen: str = "last_version") -> DataFrame:
    """Numbers the changes of each entry on from the last version seen, each idempotency key once."""
    w = W.partitionBy(id).orderBy(order, "idempotency_key")
    once = changes.withColumn("_n", F.row_number().over(W.partitionBy("idempotency_key").orderBy(order, id))).filter("_n = 1").drop("_n")
    return once.withColumn("version", F.coalesce(F.col(seen), F.lit(0)) + F.row_number().over(w))


# ---- candidates and plans


def fold_candidates(candidates: DataFrame, key: Column, id: str = "candidate_id", evidence: str = "evidence") -> DataFrame:
    """(survivor_id, duplicates, evidence): per key the first candidate by (created_at, id), how many copies it has, and all evidence.

    Copies are counted where they lie before anything is shuffled, and `members` lists them a row each, so a key that a third of
    the candidates share is never gathered; its distinct evidence is.
    """
    rows = candidates.withColumn("_key", key)
    folded = rows.groupBy("_key").agg(F.min_by(id, F.struct("created_at", id)).alias("survivor_id"), (F.count("*") - 1).alias("duplicates"))
    proof = rows.select("_key", F.explode_outer(evidence).alias("e")).distinct().groupBy("_key").agg(F.array_sort(F.collect_list("e")).alias("evidence"))
    return folded.join(proof, "_key").drop("_key")


def members(candidates: DataFrame, key: Column, id: str = "candidate_id") -> DataFrame:
    """(candidate, survivor_id): every candidate and the first one of its key, itself included."""
    rows = candidates.withColumn("_key", key)
    return rows.join(rows.groupBy("_key").agg(F.min_by(id, F.struct("created_at", id)).alias("survivor_id")), "_key").select(id, "survivor_id")


DURABLE = ("fact", "decision", "convention", "procedure", "task")
PROMOTED = ("fact", "decision", "convention", "procedure")


def evidence_gate(proposals: DataFrame, evidence: DataFrame, id: str = "proposal_id") -> DataFrame:
    """(id, verdict) of creates: noop, candidate for review, reinforce or apply.

    `proposals`: id, kind, scope_kind, confidence_signal, importance_signal, key_taken, same_text (an active entry of the scope has the
    text). `evidence`: id, evidence_kind, in_window. Durable kinds need a user's statement from the window; promoted kinds must not
    rest on a model's claims alone; a taken key is always reviewed.
    """
    said = (F.col("evidence_kind") == "user_statement") & F.col("in_window")
    seen = evidence.groupBy(id).agg(F.max(said).alias("user"), F.min(F.col("evidence_kind") == "model_claim").alias("only_model"))
    rows = proposals.join(seen, id, "left")
    known = F.col("kind").isin(*KINDS) & F.col("scope_kind").isin("global", "repo", "worktree")
    signals = F.lower("confidence_signal").isin("low", "medium", "high") & F.lower("importance_signal").isin("low", "medium", "high")
    review = (F.col("kind").isin(*DURABLE) & ~F.coalesce("user", F.lit(False))) | (F.col("kind").isin(*PROMOTED) & F.coalesce("only_model", F.lit(False)))
    verdict = F.when(~F.coalesce(known & signals, F.lit(False)), "noop").when(review | F.col("key_taken"), "candidate").when(F.col("same_text"), "reinforce").otherwise("apply")
    return rows.select(id, verdict.alias("verdict"))


def collapse(plan: DataFrame, target: str = "target_id") -> DataFrame:
    """One operation for each target: what decides its fate beats what adds evidence (reinforcements and candidates), the later of
    equals wins; all citations stay, in order. Operations that do nothing have no target."""
    claim = F.when(F.col("op").isin("reinforce", "candidate"), 1).otherwise(2)
    rows = plan.filter("op <> 'noop'").withColumn("_claim", claim)
    return rows.groupBy(target).agg(
        F.max_by("op", F.struct("_claim", "index")).alias("op"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("index", "citations"))), lambda x: x["citations"]))).alias("citations"),
    )


# ---- consolidation


def consolidation_window(envelopes: DataFrame, cursors: DataFrame, batch: int = 20, limit: int = 12_000, session: str = "session_id", seq: str = "received_seq") -> DataFrame:
    """Per session the rows after the cursor, at most `batch`, as long as their texts sum up to `limit`; the first always counts."""
    w = W.partitionBy(session).orderBy(seq)
    rows = envelopes.join(cursors, session, "left").filter(F.col(seq) > F.coalesce("last_seq", F.lit(0)))
    rows = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= batch)
    size = F.length(F.coalesce("excerpt", F.lit("(no excerpt)")))
    rows = rows.withColumn("cum", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))).filter((F.col("n") == 1) | (F.col("cum") <= limit))
    return rows.groupBy(session).agg(F.min(seq).alias("from_seq"), F.max(seq).alias("to_seq"), F.count("*").alias("n"))


def backlog(envelopes: DataFrame, cursors: DataFrame, session: str = "session_id", seq: str = "received_seq") -> DataFrame:
    """Sessions with rows after their cursor."""
    seen = envelopes.groupBy(session).agg(F.max(seq).alias("last"))
    late = envelopes.join(cursors, session, "left").filter(F.col(seq) > F.coalesce("last_seq", F.lit(0))).groupBy(session).agg(F.count("*").alias("pending"))
    return seen.join(cursors, session, "left").filter(F.col("last") > F.coalesce("last_seq", F.lit(0))).join(late, session).select(session, "last", "pending")


def due(envelopes: DataFrame, cursors: DataFrame, now_ms: int, threshold: int = 50, idle_ms: int = 24 * 3_600_000, stops: tuple[str, ...] = ("Stop", "SessionEnd"), session: str = "session_id") -> DataFrame:
    """(session, reason): threshold, stop or idle, the first that holds."""
    late = envelopes.join(cursors, session, "left").filter(F.col("received_seq") > F.coalesce("last_seq", F.lit(0)))
    facts = late.groupBy(session).agg(F.count("*").alias("n"), F.max(F.col("event_type").isin(*stops)).alias("stop"), F.max("at_ms").alias("last_at"))
    reason = F.when(F.col("n") >= threshold, "threshold").when(F.col("stop"), "stop").when(now_ms - F.col("last_at") >= idle_ms, "idle")
    return facts.withColumn("reason", reason).filter("reason is not null").select(session, "n", "reason")


def retry(runs: DataFrame, now_ms: int, build: str) -> DataFrame:
    """Runs and what to do with them: leases that ran out are stale, mechanical failures wait for another build, and windows that were
    too large shrink by half down to one."""
    action = (
        F.when((F.col("state") == "running") & (F.col("lease_until") <= now_ms), "stale")
        .when((F.col("state") == "failed") & F.col("failed_build").isNotNull() & (F.col("failed_build") == build), "parked")
        .when((F.col("state") == "failed") & (F.col("next_attempt_at") > now_ms), "waiting")
        .when((F.col("state") == "failed") & (F.col("error") == "overflow") & (F.col("batch") > 1), "shrink")
        .when((F.col("state") == "failed") & (F.col("error") == "overflow"), "floored")
        .when(F.col("state") == "failed", "retry")
        .otherwise("none")
    )
    return runs.withColumn("action", action).withColumn("next_batch", F.when(F.col("action") == "shrink", F.greatest(F.floor(F.col("batch") / 2), F.lit(1)).cast("long")).otherwise(F.col("batch")))


def _observed(runs: DataFrame, envelopes: DataFrame, session: str) -> DataFrame:
    """Runs and `observations`, the envelopes in their window."""
    seen = range_counts(runs, envelopes, session, "from_seq", "to_seq", "received_seq", "run_id").withColumnRenamed("n", "observations")
    return runs.join(seen, "run_id")


def stuck_runs(runs: DataFrame, cursors: DataFrame, envelopes: DataFrame, build: str, attempts: int = 3, session: str = "session_id") -> DataFrame:
    """Failed runs past their session's cursor that were tried often or wait for another build, but for a session's latest failure
    that still can shrink. `runs`: run_id, session, state, attempt, failure_kind, failed_build, overflow, created_at, from_seq, to_seq."""
    dead = (F.coalesce("failure_kind", F.lit("")) == "mechanical") & (F.coalesce("failed_build", F.lit("")) == build)
    failed = runs.filter("state = 'failed'").withColumn("dead_lettered", dead).withColumn("_latest", F.max("created_at").over(W.partitionBy(session)) == F.col("created_at"))
    late = failed.join(cursors, session, "left").filter((F.col("to_seq") > F.coalesce("last_seq", F.lit(0))) & ((F.col("attempt") >= attempts) | F.col("dead_lettered")))
    shrinks = F.col("overflow") & F.col("dead_lettered") & F.col("_latest") & (F.col("observations") > 1)
    return _observed(late, envelopes, session).filter(~shrinks).select("run_id", session, "attempt", "dead_lettered", "observations")


def blockers(runs: DataFrame, envelopes: DataFrame, build: str, session: str = "session_id") -> DataFrame:
    """(session, run_id, blocker) by the latest run of each session that wasn't applied; sessions without one have no blocker."""
    w = W.partitionBy(session).orderBy(F.desc("created_at"), F.desc("run_id"))
    latest = runs.filter("state <> 'applied'").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    dead = (F.coalesce("failure_kind", F.lit("")) == "mechanical") & (F.coalesce("failed_build", F.lit("")) == build)
    blocker = (
        F.when(F.col("state") != "failed", "in_progress").when(~dead, "retryable").when(~F.col("overflow"), "parked")
        .when(F.col("observations") <= 1, "floored").otherwise("shrinking")
    )
    return _observed(latest, envelopes, session).select(session, "run_id", blocker.alias("blocker"))


def pending_normalization(entries: DataFrame, done: DataFrame, version: int, now_ms: int, attempts: int = 5) -> DataFrame:
    """Live entries without a normalisation, with an older one, with a failed one that may be tried again, or with one whose text may
    have changed. `done`: entry_id, status, attempt_count, next_attempt_at, normalizer_version."""
    d = done.withColumn("_seen", F.lit(True))
    rows = entries.filter(~F.col("state").isin(*TERMINAL)).join(d, "entry_id", "left")
    again = (F.col("status") == "failed") & (F.col("attempt_count") < attempts) & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now_ms))
    return rows.filter(F.col("_seen").isNull() | (F.col("normalizer_version") < version) | again | F.col("status").isin("translated", "english")).select(*entries.columns)


# ---- privacy


def purge(entries: DataFrame, evidence: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and evidence without the entries named."""
    gone = ids.select("entry_id").distinct()
    return entries.join(gone, "entry_id", "left_anti"), evidence.join(gone, "entry_id", "left_anti")


def purge_session(entries: DataFrame, evidence: DataFrame, envelopes: DataFrame, session: object) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, evidence and envelopes without a session: its envelopes go, evidence that rests on them goes with them, and so do
    entries that have no evidence left."""
    gone = envelopes.filter(F.col("session_id") == F.lit(session)).select("event_id").distinct()
    left = evidence.join(gone, "event_id", "left_anti")
    had = evidence.join(gone, "event_id", "left_semi").select("entry_id").distinct()
    orphans = had.join(left.select("entry_id").distinct(), "entry_id", "left_anti")
    return entries.join(orphans, "entry_id", "left_anti"), left.join(orphans, "entry_id", "left_anti"), envelopes.filter(~F.col("session_id").eqNullSafe(F.lit(session)))


def purge_preview(before: dict[str, DataFrame], after: dict[str, DataFrame] | None = None) -> DataFrame:
    """(name, rows, gone) of each table: what a purge would delete; without `after`, of everything."""
    counted = lambda name, table, rows, gone: table.agg(F.lit(name).alias("name"), (F.count("*") * rows).alias("rows"), (F.count("*") * gone).alias("gone"))
    parts = [counted(name, table, 1, 1) for name, table in before.items()] + [counted(name, table, 0, -1) for name, table in (after or {}).items()]
    return reduce(DataFrame.unionByName, parts).groupBy("name").agg(F.sum("rows").alias("rows"), F.sum("gone").alias("gone"))


def inspect(entries: DataFrame, evidence: DataFrame, audits: DataFrame) -> DataFrame:
    """Entries with their evidence and audit trail nested, in order."""
    ev = evidence.groupBy("entry_id").agg(F.array_sort(F.collect_list("event_id")).alias("evidence"))
    au = audits.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("version", "op"))).alias("audit"))
    none = F.array().cast("array<bigint>")
    return entries.join(ev, "entry_id", "left").join(au, "entry_id", "left").withColumn("evidence", F.coalesce("evidence", none)).orderBy("created_at", "entry_id")


# Entries on a page unless a call says so, and at most.
LIST_LIMIT, LIST_MOST = 20, 100


def list_entries(entries: DataFrame, scopes: list[tuple[str, object]], kind: str | None = None, state: str | None = None, limit: int = LIST_LIMIT, offset: int = 0) -> DataFrame:
    """A page by (created_at, id) of at most `LIST_MOST` entries, with the total and if there is more."""
    limit = min(limit, LIST_MOST)
    rows = None
    for k, owner in scopes:
        part = in_scope(entries, k, owner, live_only=False)
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.dropDuplicates(["entry_id"])
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if state is not None:
        rows = rows.filter(F.col("state") == state)
    total = rows.count()
    return rows.orderBy("created_at", "entry_id").offset(offset).limit(limit).withColumn("total", F.lit(total)).withColumn("has_more", F.lit(total > offset + limit))


def remember(new: DataFrame) -> DataFrame:
    """Rows that a user creates: confidence by confirmation, medium importance unless given, a key of session and request."""
    return (
        new.withColumn("confidence", F.when(F.col("confirmed"), 0.85).otherwise(0.6))
        .withColumn("importance", F.coalesce("importance", F.lit(0.6)))
        .withColumn("idempotency_key", F.concat_ws(":", F.lit("mcp-remember"), "session_id", "request_id"))
        .withColumn("evidence_kind", F.lit("user_statement"))
    )


def feedback(given: DataFrame) -> DataFrame:
    """Envelopes of users' feedback, without text, one for each key."""
    key = F.concat_ws(":", F.lit("mcp"), "session_id", "request_id")
    return given.select("session_id", F.lit("McpFeedback").alias("event_type"), F.lit("user_statement").alias("evidence_kind"), F.lit("normal").alias("trust"), key.alias("dedup_key")).dropDuplicates(["dedup_key"])
