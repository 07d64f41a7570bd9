"""Queries over the entry store, its stream, retention and state machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import identity
from tessera.operators import ledger, retention
from tessera.plans.views import NOW, entries, files, observations, with_
from tessera.session import table
from tessera.streaming import observations as stream

Q, SQL = {}, {}
_LIVE = "state NOT IN ('resolved', 'retracted', 'rejected', 'superseded')"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _ops(spark, d, columns: str):
    """Every third entry is operated on, half of them with the version that they have."""
    m = entries(spark, d).filter("entry_id % 3 = 0")
    return m.selectExpr("entry_id", "case when turn % 2 = 0 then entry_version else entry_version + 1 end as expected_version", columns)


@query("m1a_create", with_("mem", rest="""new AS (SELECT entry_id + 1000000 AS entry_id, scope_kind, scope_owner, kind, canonical_key, role, 'i' || (entry_id % 50) AS ik FROM mem),
one AS (SELECT *, row_number() OVER (PARTITION BY ik ORDER BY entry_id) AS n FROM new),
""" + f"free AS (SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_owner, canonical_key ORDER BY entry_id) AS nth FROM one o WHERE n = 1 AND NOT (kind IN ('fact', 'decision', 'convention', 'procedure') AND role = 'assistant') AND ik NOT IN (SELECT 'i' || entry_id FROM mem) AND NOT EXISTS (SELECT 1 FROM mem m WHERE m.{_LIVE} AND m.scope_kind = o.scope_kind AND m.scope_owner = o.scope_owner AND m.canonical_key = o.canonical_key))") + "SELECT entry_id, kind, 'active' AS state, CAST(1 AS BIGINT) AS entry_version FROM free WHERE canonical_key IS NULL OR nth = 1")
def m1a(spark, d):
    m = entries(spark, d)
    new = m.select((F.col("entry_id") + 1_000_000).alias("entry_id"), "scope_kind", "scope_owner", "kind", "canonical_key", F.when(F.col("role") == "assistant", "model_claim").otherwise("user_statement").alias("evidence_kind"), F.concat(F.lit("i"), F.col("entry_id") % 50).alias("idempotency_key"))
    old = m.withColumn("idempotency_key", F.concat(F.lit("i"), F.col("entry_id")))
    return ledger.create(old, new, F.lit(NOW)).select("entry_id", "kind", "state", "entry_version")


@query("m1b_reinforce", with_("mem") + "SELECT entry_id, CASE WHEN turn % 4 = 0 THEN 0.9::DOUBLE ELSE confidence END AS confidence, entry_version + 1 AS entry_version FROM mem WHERE entry_id % 3 = 0 AND turn % 2 = 0")
def m1b(spark, d):
    return ledger.reinforce(entries(spark, d), _ops(spark, d, "case when turn % 4 = 0 then 0.9d end as confidence"))


@query("m1c_change_state", with_("mem", rest="""legal(kind, state, to_state) AS (SELECT * FROM (VALUES ('task','active','resolved'), ('task','active','retracted'), ('question','active','resolved'), ('question','active','retracted'), ('hypothesis','active','confirmed'), ('hypothesis','active','rejected'), ('hypothesis','active','superseded'), ('hypothesis','confirmed','superseded'),
 ('fact','active','superseded'), ('fact','active','retracted'), ('decision','active','superseded'), ('decision','active','retracted'), ('convention','active','superseded'), ('convention','active','retracted'), ('procedure','active','superseded'), ('procedure','active','retracted')) v),
o AS (SELECT m.*, (['resolve','retract','confirm','reject'])[CAST(conv_id % 4 AS INTEGER) + 1] AS op, (['resolved','retracted','confirmed','rejected'])[CAST(conv_id % 4 AS INTEGER) + 1] AS t FROM mem m WHERE entry_id % 3 = 0),
r AS (SELECT o.*, CASE WHEN turn % 2 = 1 THEN 'version_conflict' WHEN o.state = t THEN 'unchanged' WHEN l.kind IS NOT NULL THEN 'applied' ELSE 'illegal' END AS outcome FROM o LEFT JOIN legal l ON l.kind = o.kind AND l.state = o.state AND l.to_state = o.t)""") + "SELECT entry_id, op, state AS from_state, t AS to_state, entry_version + CASE WHEN outcome = 'applied' THEN 1 ELSE 0 END AS entry_version, outcome FROM r")
def m1c(spark, d):
    return ledger.change_state(entries(spark, d), _ops(spark, d, "element_at(array('resolve','retract','confirm','reject'), cast(entry_id div 1000 % 4 + 1 as int)) as op"))


@query("m1d_supersede", with_("mem", rest=f"s AS (SELECT * FROM mem WHERE entry_id % 4 = 1 AND {_LIVE})") + "SELECT entry_id, 'superseded' AS state, entry_version + 1 AS entry_version, NULL::BIGINT AS supersedes_id, text, scope_kind FROM s UNION ALL SELECT entry_id + 5000000, 'active', 1, entry_id, 'new ' || entry_id, scope_kind FROM s")
def m1d(spark, d):
    m = entries(spark, d)
    ops = m.filter("entry_id % 4 = 1").select("entry_id", (F.col("entry_id") + 5_000_000).alias("new_id"), F.concat(F.lit("new "), F.col("entry_id")).alias("new_text"))
    return ledger.supersede(m, ops).select("entry_id", "state", "entry_version", "supersedes_id", "text", "scope_kind")


@query("m1e_edit", with_("mem") + f"SELECT entry_id, CASE WHEN turn % 2 = 0 THEN 'edited' ELSE text END AS text, CASE WHEN turn % 3 = 0 THEN 0.85::DOUBLE ELSE confidence END AS importance, entry_version + 1 AS entry_version, turn % 2 = 0 AND text <> 'edited' AS text_changed FROM mem WHERE entry_id % 5 = 2 AND {_LIVE}")
def m1e(spark, d):
    m = entries(spark, d).withColumn("importance", F.col("confidence"))
    ops = m.filter("entry_id % 5 = 2").select("entry_id", F.when(F.col("turn") % 2 == 0, "edited").alias("text"), F.when(F.col("turn") % 3 == 0, 0.85).alias("importance"))
    return ledger.edit(m, ops)


_MERGE = f"""p AS (SELECT conv_id * 1000 AS survivor_id, entry_id AS loser_id, entry_version, {_LIVE} AS live FROM mem WHERE turn BETWEEN 1 AND 2),
l AS (SELECT * FROM p WHERE live AND survivor_id IN (SELECT entry_id FROM mem))"""


def _merge(spark, d):
    m = entries(spark, d)
    ops = m.filter("turn between 1 and 2").select((F.col("conv_id") * 1000).alias("survivor_id"), F.col("entry_id").alias("loser_id"))
    evidence = m.select("entry_id", (F.col("entry_id") % 11).alias("event_id")).unionByName(m.select("entry_id", (F.col("entry_id") % 13).alias("event_id"))).distinct()
    return ledger.merge(m, evidence, ops)


@query("m1f_merge", with_("mem", rest=_MERGE) + "SELECT loser_id AS entry_id, 'superseded' AS state, entry_version + 1 AS entry_version, survivor_id AS superseded_by FROM l UNION ALL SELECT entry_id, state, entry_version + 1, NULL FROM mem WHERE entry_id IN (SELECT survivor_id FROM l)")
def m1f(spark, d):
    return _merge(spark, d)[0]


@query("m1f_merge_evidence", with_("mem", rest=_MERGE + ", ev AS (SELECT entry_id, entry_id % 11 AS event_id FROM mem UNION SELECT entry_id, entry_id % 13 FROM mem)") + "SELECT DISTINCT survivor_id AS entry_id, event_id FROM l JOIN ev ON entry_id = loser_id WHERE NOT EXISTS (SELECT 1 FROM ev x WHERE x.entry_id = survivor_id AND x.event_id = ev.event_id)")
def m1f2(spark, d):
    return _merge(spark, d)[1]


@query("m2_illegal_transitions", with_("mem", rest="ch AS (SELECT DISTINCT kind AS machine, state AS from_state, (['resolved','superseded','active'])[CAST(entry_id % 3 AS INTEGER) + 1] AS to_state FROM mem)") + """SELECT machine, from_state, to_state FROM ch WHERE from_state <> to_state AND NOT (
 (machine IN ('task', 'question') AND from_state = 'active' AND to_state IN ('resolved', 'retracted')) OR (machine = 'hypothesis' AND ((from_state = 'active' AND to_state IN ('confirmed', 'rejected', 'superseded')) OR (from_state = 'confirmed' AND to_state = 'superseded')))
 OR (machine IN ('fact', 'decision', 'convention', 'procedure') AND from_state = 'active' AND to_state IN ('superseded', 'retracted')))""")
def m2(spark, d):
    to = F.element_at(F.array(F.lit("resolved"), F.lit("superseded"), F.lit("active")), (F.col("entry_id") % 3 + 1).cast("int"))
    return ledger.illegal(entries(spark, d).select(F.col("kind").alias("machine"), F.col("state").alias("from_state"), to.alias("to_state")).distinct())


_LEGAL = """VALUES ('task','active','resolved'), ('task','active','retracted'), ('question','active','resolved'), ('question','active','retracted'), ('hypothesis','active','confirmed'), ('hypothesis','active','rejected'), ('hypothesis','active','superseded'), ('hypothesis','confirmed','superseded'),
 ('fact','active','superseded'), ('fact','active','retracted'), ('decision','active','superseded'), ('decision','active','retracted'), ('convention','active','superseded'), ('convention','active','retracted'), ('procedure','active','superseded'), ('procedure','active','retracted')"""


@query("sm_state_machines", with_("mem", rest=f"legal(kind, state, to_state) AS (SELECT * FROM ({_LEGAL}) v)") + "SELECT entry_id, kind, state, to_state FROM mem JOIN legal USING (kind, state)")
def sm(spark, d):
    """The states that each entry may come to."""
    moves = ledger.transitions(spark).select(F.col("machine").alias("kind"), F.col("from_state").alias("state"), "to_state")
    return entries(spark, d).join(F.broadcast(moves), ["kind", "state"]).select("entry_id", "kind", "state", "to_state")


@query("l7_m7_conflict_sets", with_("mem", rest=f"""c AS (SELECT entry_id, text, created_at, CASE WHEN entry_id % 6 = 0 THEN created_at % 7 END AS rank FROM mem WHERE {_LIVE} AND scope_kind = 'repo' AND scope_owner = 1 UNION ALL SELECT entry_id + 1000000, 'pending', created_at, NULL FROM mem WHERE {_LIVE} AND scope_kind = 'repo' AND scope_owner = 1 AND entry_id % 9 = 0),
o AS (SELECT *, row_number() OVER (ORDER BY rank IS NULL, rank, created_at DESC, entry_id DESC) AS n FROM c), t AS (SELECT *, sum(CAST(ceil(length(text) / 4.0) + 8 AS BIGINT)) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS spent FROM o WHERE n <= 50)""") + "SELECT entry_id, CAST(n AS INTEGER) AS n, CAST(spent AS BIGINT) AS spent FROM t WHERE spent <= 12000")
def l7(spark, d):
    m = entries(spark, d)
    hits = m.filter("entry_id % 6 = 0").select("entry_id", (F.col("created_at") % 7).alias("rank"))
    pending = m.filter("entry_id % 9 = 0").withColumn("entry_id", F.col("entry_id") + 1_000_000).withColumn("text", F.lit("pending"))
    return ledger.conflict_set(m, hits, "repo", 1, pending)


@query("m3_audit_versions", with_("mem", rest="one AS (SELECT *, row_number() OVER (PARTITION BY 'k' || (entry_id % 97) ORDER BY created_at, conv_id) AS n FROM mem)") + "SELECT entry_id, 2 + row_number() OVER (PARTITION BY conv_id ORDER BY created_at, 'k' || (entry_id % 97)) AS version FROM one WHERE n = 1")
def m3(spark, d):
    m = entries(spark, d).withColumn("idempotency_key", F.concat(F.lit("k"), F.col("entry_id") % 97)).withColumn("last_version", F.lit(2))
    return ledger.audit(m, "conv_id", "created_at").select("entry_id", F.col("version").cast("bigint").alias("version"))


@query("m4_evidence_gates", with_("mem", rest="ev AS (SELECT conv_id AS p, bool_or(role = 'user' AND turn > 2 AND turn % 2 = 0) AS u, bool_and(role = 'assistant' OR turn <= 2) AS om FROM mem GROUP BY conv_id), pr AS (SELECT * FROM mem WHERE turn = conv_id % 3)") + "SELECT conv_id AS proposal_id, CASE WHEN conv_id % 13 = 0 THEN 'noop' WHEN kind IN ('fact', 'decision', 'convention', 'procedure', 'task') AND NOT u THEN 'candidate' WHEN kind IN ('fact', 'decision', 'convention', 'procedure') AND om THEN 'candidate' WHEN conv_id % 10 = 0 THEN 'candidate' WHEN conv_id % 4 = 1 THEN 'reinforce' ELSE 'apply' END AS verdict FROM pr JOIN ev ON p = conv_id")
def m4(spark, d):
    m, c = entries(spark, d), F.col("conv_id")
    proposals = m.filter("turn = conv_id % 3").select(c.alias("proposal_id"), "kind", "scope_kind", F.when(c % 13 != 0, "High").alias("confidence_signal"), F.lit("low").alias("importance_signal"), (c % 10 == 0).alias("key_taken"), (c % 4 == 1).alias("same_text"))
    kind = F.when((F.col("role") == "assistant") | (F.col("turn") <= 2), "model_claim").when(F.col("role") == "user", "user_statement").otherwise("code_state")
    return ledger.evidence_gate(proposals, m.select(c.alias("proposal_id"), kind.alias("evidence_kind"), (F.col("turn") % 2 == 0).alias("in_window")))


@query("m5_plan_collapse", with_("mem", rest="o AS (SELECT conv_id AS target_id, turn, (['reinforce','resolve','noop','supersede'])[CAST((conv_id + turn) % 4 AS INTEGER) + 1] AS op FROM mem), c AS (SELECT *, CASE op WHEN 'reinforce' THEN 1 ELSE 2 END AS cl FROM o WHERE op <> 'noop')") + "SELECT target_id, op FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY cl DESC, turn DESC) AS n FROM c) WHERE n = 1")
def m5(spark, d):
    m = entries(spark, d)
    op = F.element_at(F.array(*[F.lit(x) for x in ("reinforce", "resolve", "noop", "supersede")]), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    plan = m.select(F.col("conv_id").alias("target_id"), F.col("turn").alias("index"), op.alias("op"), F.array("entry_id").alias("citations"))
    return ledger.collapse(plan).select("target_id", "op")


@query("m6_w6_candidate_fold", with_("mem", rest="k AS (SELECT *, sha256(role || '|' || kind || '|' || scope_kind) AS key FROM mem)") + "SELECT min_by(entry_id, created_at * 1000000 + entry_id) AS survivor_id, count(*) - 1 AS duplicates, count(DISTINCT entry_id % 17) AS evidence FROM k GROUP BY key")
def m6(spark, d):
    m = entries(spark, d).withColumn("evidence", F.array(F.col("entry_id") % 17))
    folded = ledger.fold_candidates(m, F.sha2(F.concat_ws("|", "role", "kind", "scope_kind"), 256), "entry_id")
    return folded.select("survivor_id", "duplicates", F.size("evidence").cast("bigint").alias("evidence"))


@query("m7_l7_conflict_set", with_("mem", rest=f"c AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN entry_id % 6 = 0 THEN 0 ELSE 1 END, CASE WHEN entry_id % 6 = 0 THEN entry_id ELSE -entry_id END) AS n FROM mem WHERE {_LIVE} AND scope_kind = 'repo'), t AS (SELECT *, sum(CAST(ceil(length(text) / 4.0) + 8 AS BIGINT)) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS spent FROM c WHERE n <= 50)") + "SELECT entry_id, CAST(n AS INTEGER) AS n, CAST(spent AS BIGINT) AS spent FROM t WHERE spent <= 12000")
def m7(spark, d):
    from pyspark.sql import Window as W

    from tessera.functions.text import token_estimate

    c = entries(spark, d).filter(~F.col("state").isin(*ledger.TERMINAL) & (F.col("scope_kind") == "repo"))
    hit = F.col("entry_id") % 6 == 0
    best = c.orderBy((~hit).cast("int"), F.when(hit, F.col("entry_id")).otherwise(-F.col("entry_id"))).limit(50)  # the prompt's size
    w = W.orderBy((~hit).cast("int"), F.when(hit, F.col("entry_id")).otherwise(-F.col("entry_id")))
    rows = best.withColumn("n", F.row_number().over(w)).withColumn("spent", F.sum(token_estimate(F.col("text"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.filter("spent <= 12000").select("entry_id", "n", "spent")


@query("m8_purge", with_("mem") + "SELECT entry_id, kind FROM mem WHERE NOT (role = 'user' AND conv_id % 4 = 0)")
def m8(spark, d):
    m = entries(spark, d)
    return ledger.purge(m, m.select("entry_id", "turn"), m.filter("role = 'user' and conv_id % 4 = 0"))[0].select("entry_id", "kind")


@query("m9_s12_inspect_export", with_("mem") + "SELECT m.entry_id, CAST(count(e.turn) AS INTEGER) AS evidence, CAST(min(CASE WHEN m.turn % 2 = 0 THEN 1 END) AS INTEGER) AS audit FROM mem m LEFT JOIN mem e ON e.conv_id = m.conv_id AND e.turn < m.turn WHERE (m.scope_kind = 'repo' AND m.scope_owner = 2) GROUP BY m.entry_id")
def m9(spark, d):
    from tessera.sources.files import export

    m = entries(spark, d)
    other = m.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    evidence = m.join(other, (F.col("conv_id") == F.col("c")) & (F.col("t") < F.col("turn"))).select("entry_id", F.col("t").alias("event_id"))
    audits = m.filter("turn % 2 = 0").select("entry_id", F.lit(1).alias("version"), F.lit("create").alias("op"))
    return export(m, evidence, audits, [("repo", 2)]).select("entry_id", F.size("evidence").alias("evidence"), F.when(F.col("audit").isNotNull(), F.size("audit")).alias("audit"))


@query("m11_m12_remember_feedback", with_("mem") + "SELECT 'mcp-remember:' || conv_id || ':' || turn AS idempotency_key, (CASE WHEN turn % 2 = 0 THEN 0.85 ELSE 0.6 END)::DOUBLE AS confidence, 0.6::DOUBLE AS importance FROM mem UNION ALL SELECT DISTINCT 'mcp:' || conv_id || ':' || (turn % 2), NULL, NULL FROM mem")
def m11(spark, d):
    m = entries(spark, d)
    made = ledger.remember(m.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("request_id"), (F.col("turn") % 2 == 0).alias("confirmed"), F.lit(None).cast("double").alias("importance")))
    said = ledger.feedback(m.select(F.col("conv_id").alias("session_id"), (F.col("turn") % 2).alias("request_id")))
    none = F.lit(None).cast("double")
    return made.select("idempotency_key", "confidence", "importance").unionByName(said.select(F.col("dedup_key").alias("idempotency_key"), none.alias("confidence"), none.alias("importance")))


# ---- the stream


@query("t1_exact_dedup", with_("obs") + "SELECT received_seq, event_type FROM (SELECT *, row_number() OVER (PARTITION BY session_id, source_event_id ORDER BY received_seq) AS n FROM obs) WHERE n = 1")
def t1(spark, d):
    o = observations(spark, d).withColumn("dedup_key", identity.framed("dedup", F.col("session_id"), F.col("source_event_id")))
    return stream.exact_dedup(o).select("received_seq", "event_type")


@query("t2_windowed_dedup", with_("obs") + "SELECT received_seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id, source_event_id ORDER BY received_seq) AS n FROM obs) WHERE n = 1")
def t2(spark, d):
    """Sessions here have fewer rows than the window, so the first of each event is all that stays; tests cover the rest."""
    return stream.windowed_dedup(observations(spark, d)).select("received_seq")


@query("t3_t6_cursors", with_("obs") + "SELECT session_id, max(received_seq) AS last_seq FROM obs GROUP BY session_id")
def t3(spark, d):
    return stream.cursors(observations(spark, d))


@query("t4_payload_ttl", with_("obs") + "SELECT received_seq, CASE WHEN at_ms + 259200000 > 1705536000000 THEN excerpt END AS payload FROM obs")
def t4(spark, d):
    o = observations(spark, d).select("received_seq", F.col("at_ms").alias("imported_at"), F.col("excerpt").alias("payload"))
    return retention.expire_payloads(o, 1_705_536_000_000).select("received_seq", "payload")


_CUR = "cur AS (SELECT session_id, min(received_seq) + 4000 AS last_seq FROM obs WHERE session_id % 3 <> 0 GROUP BY session_id)"


@query("t5_consolidation_trigger", with_("obs", rest=_CUR + ", late AS (SELECT o.session_id, count(*) AS n, bool_or(event_type = 'signup') AS stop, max(at_ms) AS last_at FROM obs o LEFT JOIN cur USING (session_id) WHERE received_seq > coalesce(last_seq, 0) GROUP BY o.session_id)") + "SELECT session_id, n, CASE WHEN n >= 50 THEN 'threshold' WHEN stop THEN 'stop' WHEN 1706659200000 - last_at >= 86400000 THEN 'idle' END AS reason FROM late WHERE n >= 50 OR stop OR 1706659200000 - last_at >= 86400000")
def t5(spark, d):
    o = observations(spark, d)
    cur = o.filter("session_id % 3 <> 0").groupBy("session_id").agg((F.min("received_seq") + 4000).alias("last_seq"))
    return ledger.due(o, cur, 1_706_659_200_000, stops=("signup",))


@query("t5_session_windows", "SELECT user_id AS session_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 24 HOURS THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL) GROUP BY user_id")
def t5b(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    return stream.sessions(e).groupBy("session_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


_RUN = "runs AS (SELECT o_orderkey AS run_id, o_custkey AS session_id, (['pending','running','failed','applied'])[CAST(o_orderkey % 4 AS INTEGER) + 1] AS state, o_orderkey % 9 AS attempt, CASE WHEN o_orderkey % 5 = 0 THEN 'b1' END AS failed_build, o_orderkey % 100 AS slot, CASE WHEN o_orderkey % 3 = 0 THEN 'overflow' ELSE 'io' END AS error, o_orderkey % 8 + 1 AS batch FROM orders)"


def _runs(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("run_id"), F.col("o_custkey").alias("session_id"), F.element_at(F.array(*[F.lit(x) for x in ("pending", "running", "failed", "applied")]), (k % 4 + 1).cast("int")).alias("state"), (k % 9).alias("attempt"),
        F.when(k % 5 == 0, "b1").alias("failed_build"), (k % 100).alias("at"), F.when(k % 3 == 0, "overflow").otherwise("io").alias("error"), (k % 8 + 1).alias("batch"),
    )


@query("t7_leases_and_retries", "WITH " + _RUN + " SELECT run_id, CASE WHEN state = 'running' AND slot <= 50 THEN 'stale' WHEN state = 'failed' AND failed_build = 'b1' THEN 'parked' WHEN state = 'failed' AND slot > 50 THEN 'waiting' WHEN state = 'failed' AND error = 'overflow' AND batch > 1 THEN 'shrink' WHEN state = 'failed' AND error = 'overflow' THEN 'floored' WHEN state = 'failed' THEN 'retry' ELSE 'none' END AS action, CASE WHEN state = 'failed' AND failed_build IS NULL AND slot <= 50 AND error = 'overflow' AND batch > 1 THEN greatest(batch // 2, 1) ELSE batch END AS next_batch FROM runs")
def t7(spark, d):
    r = _runs(spark, d).withColumn("lease_until", F.col("at")).withColumn("next_attempt_at", F.col("at"))
    return ledger.retry(r, 50, "b1").select("run_id", "action", "next_batch")


_FULL = _RUN + """, full_runs AS (SELECT *, CASE WHEN run_id % 2 = 0 THEN 'mechanical' ELSE 'transient' END AS kind, run_id % 3 = 0 AS overflow, run_id + 2000 AS to_seq FROM runs),
obs_n AS (SELECT run_id, count(event_id) AS observations FROM full_runs LEFT JOIN events ON user_id = session_id AND event_id BETWEEN run_id AND to_seq GROUP BY run_id)"""


def _full_runs(spark, d):
    r = F.col("run_id")
    return _runs(spark, d).select(
        "run_id", "session_id", "state", "attempt", "failed_build", F.when(r % 2 == 0, "mechanical").otherwise("transient").alias("failure_kind"), (r % 3 == 0).alias("overflow"),
        F.col("at").alias("created_at"), r.alias("from_seq"), (r + 2000).alias("to_seq"),
    )


@query("t8_stuck_runs", "WITH " + _FULL + """, f AS (SELECT *, kind = 'mechanical' AND coalesce(failed_build, '') = 'b1' AS dead, slot = max(slot) OVER (PARTITION BY session_id) AS latest FROM full_runs WHERE state = 'failed')
SELECT run_id, session_id, attempt, dead AS dead_lettered, observations FROM f JOIN obs_n USING (run_id) WHERE to_seq > CASE WHEN session_id % 2 = 0 THEN 9000 ELSE 0 END AND (attempt >= 3 OR dead) AND NOT (overflow AND dead AND latest AND observations > 1)""")
def t8(spark, d):
    cursors = _runs(spark, d).filter("session_id % 2 = 0").select("session_id").distinct().withColumn("last_seq", F.lit(9000))
    return ledger.stuck_runs(_full_runs(spark, d), cursors, observations(spark, d), "b1")


@query("t9_backlog_blockers", "WITH " + _FULL + """, l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY slot DESC, run_id DESC) AS n FROM full_runs WHERE state <> 'applied')
SELECT session_id, run_id, CASE WHEN state <> 'failed' THEN 'in_progress' WHEN NOT (kind = 'mechanical' AND coalesce(failed_build, '') = 'b1') THEN 'retryable' WHEN NOT overflow THEN 'parked' WHEN observations <= 1 THEN 'floored' ELSE 'shrinking' END AS blocker FROM l JOIN obs_n USING (run_id) WHERE n = 1""")
def t9(spark, d):
    return ledger.blockers(_full_runs(spark, d), observations(spark, d), "b1")


@query("t10_normalization_queue", with_("mem", rest="n AS (SELECT entry_id, (['failed','translated','given_up','english','failed'])[CAST(turn % 5 AS INTEGER) + 1] AS status, conv_id % 7 AS attempts, CASE WHEN conv_id % 3 > 0 THEN conv_id % 10 END AS next_at, 1 + turn % 2 AS version FROM mem WHERE turn % 4 <> 0)") + f"SELECT entry_id FROM mem LEFT JOIN n USING (entry_id) WHERE {_LIVE} AND (status IS NULL OR version < 2 OR (status = 'failed' AND attempts < 5 AND (next_at IS NULL OR next_at <= 4)) OR status IN ('translated', 'english'))")
def t10(spark, d):
    m, c, t = entries(spark, d), F.col("conv_id"), F.col("turn")
    status = F.element_at(F.array(*[F.lit(x) for x in ("failed", "translated", "given_up", "english", "failed")]), (t % 5 + 1).cast("int"))
    done = m.filter("turn % 4 <> 0").select("entry_id", status.alias("status"), (c % 7).alias("attempt_count"), F.when(c % 3 > 0, c % 10).alias("next_attempt_at"), (1 + t % 2).alias("normalizer_version"))
    return ledger.pending_normalization(m, done, 2, 4).select("entry_id")


# ---- retention


def _generations(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("generation_id"), F.col("o_custkey").alias("worktree_id"), k.alias("number"), (F.lit(NOW) - (k % 400) * retention.HOUR).alias("created_at"),
        F.element_at(F.array(*[F.lit(x) for x in ("retiring", "active", "failed", "retiring", "building")]), (k % 5 + 1).cast("int")).alias("state"),
    )


_GEN = "g AS (SELECT o_orderkey AS generation_id, o_custkey AS worktree_id, (['retiring','active','failed','retiring','building'])[CAST(o_orderkey % 5 AS INTEGER) + 1] AS state, o_orderkey % 400 AS hours FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY worktree_id, state = 'retiring' ORDER BY generation_id DESC) AS n FROM g), pin AS (SELECT generation_id FROM r WHERE state IN ('building', 'active') OR (state = 'retiring' AND (n <= 2 OR hours <= 168)))"


@query("g4_u4_pins", "WITH " + _GEN + " SELECT generation_id FROM pin UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 1000 = 0 OR o_orderkey % 997 = 0")
def g4(spark, d):
    g = _generations(spark, d)
    leases = g.select("generation_id", F.when(F.col("generation_id") % 997 == 0, NOW + 1).otherwise(NOW).alias("lease_until"))
    return retention.pinned(g, NOW, external=g.filter("generation_id % 1000 = 0"), leases=leases)


_SWEEP = _GEN + """, f AS (SELECT l_orderkey AS generation_id, l_partkey AS revision_id FROM lineitem), rev AS (SELECT p_partkey AS revision_id, p_partkey % 700 AS blob_id FROM part),
live_rev AS (SELECT DISTINCT revision_id FROM f WHERE generation_id IN (SELECT generation_id FROM pin)), live_blob AS (SELECT DISTINCT blob_id FROM rev WHERE revision_id IN (SELECT revision_id FROM live_rev)),
gone AS (SELECT generation_id FROM g WHERE generation_id NOT IN (SELECT generation_id FROM pin)), n AS (
 SELECT 0 AS position, 'edge' AS phase, count(*) AS rows FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT generation_id FROM gone)
 UNION ALL SELECT 1, 'occurrence', count(*) FROM lineitem WHERE l_orderkey IN (SELECT generation_id FROM gone) UNION ALL SELECT 2, 'file', count(*) FROM f WHERE generation_id IN (SELECT generation_id FROM gone)
 UNION ALL SELECT 3, 'skipped', count(*) FROM lineitem WHERE l_linestatus = 'O' AND l_orderkey IN (SELECT generation_id FROM gone) UNION ALL SELECT 4, 'generation', count(*) FROM gone
 UNION ALL SELECT 5, 'reference', count(*) FROM rev WHERE revision_id % 2 = 0 AND revision_id NOT IN (SELECT revision_id FROM live_rev) UNION ALL SELECT 6, 'unit', count(*) FROM rev WHERE revision_id NOT IN (SELECT revision_id FROM live_rev)
 UNION ALL SELECT 7, 'revision', count(*) FROM rev WHERE revision_id NOT IN (SELECT revision_id FROM live_rev) UNION ALL SELECT 8, 'blob', count(*) FROM (SELECT DISTINCT blob_id FROM rev) WHERE blob_id NOT IN (SELECT blob_id FROM live_blob))"""


@query("g5_sweep_plan", "WITH " + _SWEEP + " SELECT position, phase, rows, CAST(ceil(rows / 500.0) AS BIGINT) AS batches FROM n")
def g5(spark, d):
    return retention.sweep_plan(sweep_tables(spark, d), retention.pinned(_generations(spark, d), NOW))


def sweep_tables(spark, d):
    """Orders as generations, line items as their members, parts as revisions that share blobs."""
    g, li = _generations(spark, d), table(spark, d, "lineitem")
    of = lambda where: li.filter(where).select(F.col("l_orderkey").alias("generation_id"))
    rev = table(spark, d, "part").select(F.col("p_partkey").alias("revision_id"), (F.col("p_partkey") % 700).alias("blob_id"))
    return {
        "generation": g, "edge": of("l_returnflag = 'R'"), "occurrence": of("true"), "skipped": of("l_linestatus = 'O'"), "file": li.select(F.col("l_orderkey").alias("generation_id"), F.col("l_partkey").alias("revision_id")),
        "revision": rev, "unit": rev, "reference": rev.filter("revision_id % 2 = 0"), "blob": rev.select("blob_id").distinct(),
    }


@query("g3_superseded_builds", "WITH " + _GEN + ", a AS (SELECT worktree_id, max(generation_id) AS top FROM g WHERE state = 'active' GROUP BY worktree_id) SELECT generation_id FROM g JOIN a USING (worktree_id) WHERE state = 'building' AND generation_id < top")
def g3(spark, d):
    return retention.superseded_builds(_generations(spark, d)).select("generation_id")


@query("g6_switch_diff", with_("files") + "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'add' WHEN doc_id % 4 = 1 THEN 'remove' ELSE 'replace' END AS change FROM files WHERE doc_id % 4 < 2 OR doc_id % 8 = 2")
def g6(spark, d):
    f = files(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"))
    new = f.filter("doc_id % 4 <> 1").withColumn("hash", F.when(F.col("doc_id") % 8 == 2, "changed").otherwise(F.col("hash")))
    return retention.switch_diff(f.filter("doc_id % 4 <> 0"), new, "doc_id", "hash")


@query("m8_purge_preview", with_("mem", rest="ev AS (SELECT entry_id, conv_id * 10 + turn % 3 AS event_id FROM mem UNION SELECT entry_id, (conv_id + 1) * 10 FROM mem WHERE turn % 2 = 0), en AS (SELECT DISTINCT conv_id AS session_id, conv_id * 10 + turn % 3 AS event_id FROM mem), dead AS (SELECT event_id FROM en WHERE session_id = 3), lef AS (SELECT * FROM ev WHERE event_id NOT IN (SELECT event_id FROM dead)), orph AS (SELECT DISTINCT entry_id FROM ev WHERE event_id IN (SELECT event_id FROM dead) AND entry_id NOT IN (SELECT entry_id FROM lef))") + """SELECT 'entries' AS name, (SELECT count(*) FROM mem) AS rows, (SELECT count(*) FROM orph) AS gone UNION ALL SELECT 'evidence', (SELECT count(*) FROM ev), (SELECT count(*) FROM ev WHERE event_id IN (SELECT event_id FROM dead)) UNION ALL SELECT 'envelopes', (SELECT count(*) FROM en), (SELECT count(*) FROM en WHERE session_id = 3)""")
def m8b(spark, d):
    """What the purge of a session would delete."""
    m = entries(spark, d)
    own = m.select("entry_id", (F.col("conv_id") * 10 + F.col("turn") % 3).alias("event_id"))
    evidence = own.union(m.filter("turn % 2 = 0").select("entry_id", (F.col("conv_id") * 10 + 10).alias("event_id"))).distinct()
    envelopes = m.select(F.col("conv_id").alias("session_id"), (F.col("conv_id") * 10 + F.col("turn") % 3).alias("event_id")).distinct()
    before = {"entries": m, "evidence": evidence, "envelopes": envelopes}
    return ledger.purge_preview(before, dict(zip(before, ledger.purge_session(m, evidence, envelopes, 3))))
