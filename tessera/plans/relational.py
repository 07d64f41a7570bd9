"""Joins, aggregates, windows, paging and set operations of the store, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import ledger, retention
from tessera.plans.texts import REASONS, reasons
from tessera.plans.views import NOW, entries, files, observations, with_
from tessera.session import table

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- joins


_UNITS = "occ AS (SELECT doc_id, path, generation_id, sha256(text) AS blob_id, lang AS unit_kind FROM files), unit AS (SELECT DISTINCT blob_id, unit_kind FROM occ), blob AS (SELECT sha256(text) AS blob_id, max(strlen(text)) AS n_bytes FROM files GROUP BY 1)"


@query("j1_occurrence_unit_blob", with_("files", rest=_UNITS) + "SELECT doc_id, path, unit_kind, n_bytes FROM occ JOIN unit USING (blob_id, unit_kind) JOIN blob USING (blob_id) WHERE generation_id = 'g1'")
def j1(spark, d):
    """Occurrences of a generation with their units and the blobs that the units share."""
    f = files(spark, d).select("doc_id", "path", "generation_id", F.sha2("text", 256).alias("blob_id"), F.col("lang").alias("unit_kind"), F.octet_length("text").alias("n_bytes"))
    blob = f.groupBy("blob_id").agg(F.max("n_bytes").cast("bigint").alias("n_bytes"))
    occ = f.filter("generation_id = 'g1'").select("doc_id", "path", "blob_id", "unit_kind")
    return occ.join(f.select("blob_id", "unit_kind").distinct(), ["blob_id", "unit_kind"]).join(blob, "blob_id").select("doc_id", "path", "unit_kind", "n_bytes")


@query("j2_occurrence_unit", with_("files") + "SELECT f.doc_id, path, quality FROM files f JOIN labels l ON f.doc_id = l.doc_id")
def j2(spark, d):
    return files(spark, d).join(table(spark, d, "labels"), "doc_id").select("doc_id", "path", "quality")


@query("j3_file_references", with_("files", rest="r AS (SELECT page_id, TRY_CAST(regexp_extract(coalesce(url, ''), '/([0-9]+)', 1) AS BIGINT) AS doc_id FROM pages)") + "SELECT path, count(*) AS references_in, min(page_id) AS first_page FROM r JOIN files USING (doc_id) GROUP BY path")
def j3(spark, d):
    """Files with the pages whose urls refer to them."""
    refs = table(spark, d, "pages").select("page_id", F.expr("try_cast(regexp_extract(coalesce(url, ''), '/([0-9]+)', 1) as bigint)").alias("doc_id")).filter("doc_id is not null")
    return files(spark, d).select("doc_id", "path").join(refs, "doc_id").groupBy("path").agg(F.count("*").alias("references_in"), F.min("page_id").alias("first_page"))


@query("j4_left_count", with_("files") + "SELECT source, lang, count(l.doc_id) AS labelled FROM files f LEFT JOIN labels l ON f.doc_id = l.doc_id GROUP BY source, lang")
def j4(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.lit(1).alias("has"))
    return files(spark, d).join(labels, "doc_id", "left").groupBy("source", "lang").agg(F.count("has").alias("labelled"))


@query("j5_envelope_payload", with_("obs", rest="p AS (SELECT received_seq, excerpt FROM obs WHERE received_seq % 3 <> 0)") + "SELECT o.session_id, count(*) AS n, count(p.excerpt) AS with_payload FROM obs o LEFT JOIN p USING (received_seq) GROUP BY o.session_id")
def j5(spark, d):
    o = observations(spark, d)
    p = o.filter("received_seq % 3 <> 0").select("received_seq", F.col("excerpt").alias("payload"))
    return o.join(p, "received_seq", "left").groupBy("session_id").agg(F.count("*").alias("n"), F.count("payload").alias("with_payload"))


@query("j6_pending_normalization", with_("mem", rest="norm AS (SELECT entry_id, turn % 3 AS attempts, 1 + turn % 2 AS version FROM mem WHERE turn % 4 <> 0)") + "SELECT m.entry_id FROM mem m LEFT JOIN norm n USING (entry_id) WHERE n.entry_id IS NULL OR n.version < 2 OR (n.attempts > 0 AND n.attempts < 2)")
def j6(spark, d):
    m = entries(spark, d)
    n = m.filter("turn % 4 <> 0").select("entry_id", (F.col("turn") % 3).alias("attempts"), (1 + F.col("turn") % 2).alias("version"), F.lit(True).alias("seen"))
    return m.select("entry_id").join(n, "entry_id", "left").filter("seen is null or version < 2 or (attempts > 0 and attempts < 2)").select("entry_id")


@query("j7_search_postings", with_("files", rest="t AS (SELECT DISTINCT doc_id, unnest(string_split(path, '/')) AS term FROM files), q AS (SELECT item_id, 'src' || (item_id % 5) AS term FROM benchmark)") + "SELECT item_id, doc_id FROM q JOIN t USING (term)")
def j7(spark, d):
    """Terms of questions against the terms of paths."""
    terms = files(spark, d).select("doc_id", F.explode(F.array_distinct(F.split("path", "/"))).alias("term"))
    asked = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("src"), F.col("item_id") % 5).alias("term"))
    return terms.join(asked, "term").select("item_id", "doc_id")


@query("j8_anti_not_live", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j8(spark, d):
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(returned, "o_orderkey", "left_anti")


@query("j9_semi_in_candidates", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j9(spark, d):
    rich = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(rich, "c_custkey", "left_semi")


@query("j10_correlated_max", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_order, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def j10(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last_order"), F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", "last_order", F.coalesce("n", F.lit(0)).alias("n"))


_RUNS = "runs AS (SELECT session_id, event_type, min(received_seq) AS from_seq, min(received_seq) + 500 AS to_seq FROM obs GROUP BY session_id, event_type)"


@query("j11_range_join", with_("obs", rest=_RUNS) + "SELECT r.session_id, r.event_type, r.from_seq, count(o.received_seq) AS n FROM runs r LEFT JOIN obs o ON o.session_id = r.session_id AND o.received_seq BETWEEN r.from_seq AND r.to_seq GROUP BY ALL")
def j11(spark, d):
    from tessera.operators.stats import range_counts

    o = observations(spark, d)
    r = o.groupBy("session_id", "event_type").agg(F.min("received_seq").alias("from_seq")).withColumn("to_seq", F.col("from_seq") + 500)
    r = r.withColumn("run", F.concat_ws("|", "session_id", "event_type"))
    return r.join(range_counts(r, o, "session_id", "from_seq", "to_seq", "received_seq", "run"), "run").select("session_id", "event_type", "from_seq", "n")


@query("j12_vector_lookup", with_("files") + "SELECT doc_id, path, label FROM files JOIN embeddings ON doc_id = vec_id")
def j12(spark, d):
    return files(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").select("doc_id", "path", "label")


@query("j14_expected_actual", "SELECT doc_id AS id, 'missing' AS divergence FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'orphaned' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def j14(spark, d):
    docs, vecs = table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return docs.join(vecs, "id", "left_anti").withColumn("divergence", F.lit("missing")).unionByName(vecs.join(labels, "id", "left_anti").withColumn("divergence", F.lit("orphaned")))


@query("j15_smallest_enclosing", """WITH u AS (SELECT o_custkey AS f, o_orderkey AS i, CAST(o_totalprice AS BIGINT) AS a, CAST(o_totalprice AS BIGINT) + (o_orderkey * 7919) % 200000 AS b FROM orders),
p AS (SELECT c.f, c.i, p.i AS parent, row_number() OVER (PARTITION BY c.f, c.i ORDER BY p.b - p.a, p.i DESC) AS n FROM u c JOIN u p ON c.f = p.f AND p.a <= c.a AND p.b >= c.b AND (p.a <> c.a OR p.b <> c.b))
SELECT u.i AS unit, parent FROM u LEFT JOIN p ON u.f = p.f AND u.i = p.i AND n = 1""")
def j15(spark, d):
    from tessera.operators.chunk import parents

    a = F.rint("o_totalprice").cast("bigint")
    u = table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("index"), a.alias("start"), (a + F.col("o_orderkey") * 7919 % 200000).alias("end"))
    return parents(u).select(F.col("index").alias("unit"), "parent")


@query("j16_root_resolution", """WITH roots AS (SELECT doc_id AS root_id, sha256(text) AS fingerprint, source || '/' || lang AS hint FROM documents WHERE doc_id % 3 = 0), fp AS (SELECT fingerprint, min(root_id) AS root_id FROM roots GROUP BY 1), h AS (SELECT hint, count(*) AS n FROM roots GROUP BY 1)
SELECT doc_id, CASE WHEN fp.root_id IS NOT NULL THEN 'resolved' WHEN h.n = 1 THEN 'resolved_by_hint' WHEN h.n > 1 THEN 'ambiguous' ELSE 'global_only' END AS resolution, coalesce(h.n, 0) AS hints
FROM documents d LEFT JOIN fp ON fp.fingerprint = sha256(d.text) LEFT JOIN h ON h.hint = d.source || '/' || CASE WHEN d.doc_id % 10 = 1 THEN 'x' || d.doc_id ELSE d.lang END""")
def j16(spark, d):
    """Documents against known roots: by the fingerprint of the text, else by source and language as a hint."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"), "source", "lang")
    roots = docs.filter("doc_id % 3 = 0")
    exact = roots.select("fingerprint").distinct().withColumn("current", F.lit(True))
    hints = roots.groupBy(F.concat_ws("/", "source", "lang").alias("hint")).agg(F.count("*").alias("n"))
    asked = docs.withColumn("hint", F.concat_ws("/", "source", F.when(F.col("doc_id") % 10 == 1, F.concat(F.lit("x"), "doc_id")).otherwise(F.col("lang"))))
    resolution = F.when(F.col("current"), "resolved").when(F.col("n") == 1, "resolved_by_hint").when(F.col("n") > 1, "ambiguous").otherwise("global_only")
    return asked.join(exact, "fingerprint", "left").join(hints, "hint", "left").select("doc_id", resolution.alias("resolution"), F.coalesce("n", F.lit(0)).alias("hints"))


# ---- aggregates


@query("a1_top_imports", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, event_type, k LIMIT 20")
def a1(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint").alias("k")
    return table(spark, d, "events").groupBy("event_type", k).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type", "k").limit(20)


@query("a2_occurrences_per_file", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def a2(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("a3_directory_rollup", with_("files", rest="""p AS (SELECT string_split(path, '/') AS s FROM files),
x AS (SELECT unnest(range(0, least(len(s) - 1, 3) + 1)) AS depth, s FROM p)""") + "SELECT depth, array_to_string(s[1:depth], '/') AS directory, count(*) AS files FROM x GROUP BY ALL")
def a3(spark, d):
    from tessera.operators.stats import directory_rollup

    return directory_rollup(files(spark, d)).select(F.col("depth").cast("bigint").alias("depth"), "directory", "files")


@query("a4_skip_tally", f"SELECT {REASONS} AS reason, count(*) AS n FROM documents GROUP BY 1")
def a4(spark, d):
    return reasons(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query("a5_entries_by_kind_state", with_("mem") + "SELECT kind, state, count(*) AS n FROM mem GROUP BY kind, state")
def a5(spark, d):
    return entries(spark, d).groupBy("kind", "state").agg(F.count("*").alias("n"))


@query("a6_a8_status_counts", with_("mem") + "SELECT 'role' AS what, role AS status, count(*) AS n FROM mem GROUP BY role UNION ALL SELECT 'scope', scope_kind, count(*) FROM mem GROUP BY scope_kind")
def a6(spark, d):
    m = entries(spark, d)
    by = lambda what, c: m.groupBy(F.lit(what).alias("what"), F.col(c).alias("status")).agg(F.count("*").alias("n"))
    return by("role", "role").unionByName(by("scope", "scope_kind"))


@query("a9_a10_scalars", with_("obs") + "SELECT CAST(coalesce(sum(length(excerpt)), 0) AS BIGINT) AS chars, min(received_seq) AS first_seq, max(received_seq) AS last_seq FROM obs WHERE event_type <> 'none'")
def a9(spark, d):
    return observations(spark, d).filter("event_type <> 'none'").agg(F.coalesce(F.sum(F.length("excerpt")), F.lit(0)).alias("chars"), F.min("received_seq").alias("first_seq"), F.max("received_seq").alias("last_seq"))


_CURSORS = "cur AS (SELECT session_id, min(received_seq) + 4000 AS last_seq FROM obs WHERE session_id % 3 <> 0 GROUP BY session_id)"


def _cursors(o):
    return o.filter("session_id % 3 <> 0").groupBy("session_id").agg((F.min("received_seq") + 4000).alias("last_seq"))


@query("a11_a12_backlog", with_("obs", rest=_CURSORS) + "SELECT o.session_id, max(received_seq) AS last, count(*) FILTER (WHERE received_seq > coalesce(last_seq, 0)) AS pending FROM obs o LEFT JOIN cur USING (session_id) GROUP BY o.session_id HAVING max(received_seq) > coalesce(max(last_seq), 0)")
def a11(spark, d):
    o = observations(spark, d)
    return ledger.backlog(o, _cursors(o))


@query("a13_distinct_sessions", with_("obs") + "SELECT event_type, count(DISTINCT session_id) AS sessions FROM obs GROUP BY event_type")
def a13(spark, d):
    return observations(spark, d).groupBy("event_type").agg(F.countDistinct("session_id").alias("sessions"))


@query("a14_unaccounted", with_("files") + "SELECT regexp_extract(path, '[^/]\\.([^./]+)$', 1) AS ext, count(*) AS n FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1 ORDER BY n DESC, ext")
def a14(spark, d):
    from tessera.operators.stats import unaccounted

    return unaccounted(files(spark, d), table(spark, d, "labels").select("doc_id"), "doc_id").select(F.col("extension").alias("ext"), "n")


@query("a15_throughput", "SELECT CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS done, count(*) AS total, round(100.0 * count(*) FILTER (WHERE event_type = 'purchase') / count(*), 6) AS pct, round(count(*) FILTER (WHERE event_type = 'purchase' AND event_id % 10 = 0) / 5.0, 6) AS per_minute FROM events")
def a15(spark, d):
    from tessera.operators.stats import progress

    return progress(table(spark, d, "events"), F.col("event_type") == "purchase", (F.col("event_type") == "purchase") & (F.col("event_id") % 10 == 0)).select("done", "total", "pct", "per_minute")


@query("a16_embedding_coverage", with_("files") + "SELECT lang, count(*) AS expected, count(vec_id) AS ready, least(count(*) - count(vec_id), count(*) FILTER (WHERE doc_id % 11 = 0)) AS failed FROM files LEFT JOIN embeddings ON doc_id = vec_id GROUP BY lang")
def a16(spark, d):
    from tessera.operators.stats import coverage

    f = files(spark, d).select(F.col("doc_id").alias("subject"), "lang")
    return coverage(f, table(spark, d, "embeddings").select(F.col("vec_id").alias("subject")), f.filter("subject % 11 = 0").select("subject"), "lang")


@query("a17_tool_telemetry", "SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE value < 10) AS errors, CAST(sum(length(props)) AS BIGINT) AS bytes, round(sum(value), 4) AS total_ms FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 500 GROUP BY event_type")
def a17(spark, d):
    from tessera.operators.stats import telemetry

    e = table(spark, d, "events").select("event_type", "event_id", (F.col("value") < 10).alias("error"), F.length("props").alias("bytes"), F.col("value").alias("ms"))
    return telemetry(e, "event_type", "event_id").select("event_type", "calls", "errors", "bytes", "total_ms")


# ---- windows


@query("w1_consolidation_window", with_("obs", rest=_CURSORS + """, late AS (SELECT o.*, row_number() OVER w AS n, sum(length(coalesce(excerpt, '(no excerpt)'))) OVER w AS cum FROM obs o LEFT JOIN cur USING (session_id)
  WHERE received_seq > coalesce(last_seq, 0) WINDOW w AS (PARTITION BY o.session_id ORDER BY received_seq ROWS UNBOUNDED PRECEDING))""") + "SELECT session_id, min(received_seq) AS from_seq, max(received_seq) AS to_seq, count(*) AS n FROM late WHERE n <= 20 AND (n = 1 OR cum <= 120) GROUP BY session_id")
def w1(spark, d):
    o = observations(spark, d)
    return ledger.consolidation_window(o, _cursors(o), limit=120)


@query("w3_keep_last_k", "SELECT o_orderkey AS generation_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'O' ORDER BY epoch_us(o_orderdate) // 1000 DESC, o_orderkey) AS n FROM orders) WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND n <= 2)")
def w3(spark, d):
    g = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("generation_id"), F.col("o_custkey").alias("worktree_id"), F.when(F.col("o_orderstatus") == "O", "retiring").when(F.col("o_orderstatus") == "F", "active").otherwise("failed").alias("state"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("number"), F.lit(0).cast("bigint").alias("created_at"),
    )
    return retention.pinned(g, NOW)


@query("w4_evict_to_budget", "WITH c AS (SELECT o_orderkey AS key, CAST(o_totalprice AS BIGINT) AS bytes, epoch_us(o_orderdate) // 1000 AS last_used FROM orders), f AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY last_used, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM c WHERE key % 10 <> 0) SELECT key, bytes FROM f WHERE freed < (SELECT greatest(sum(bytes) - 500000000, 0) FROM c)")
def w4(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.rint("o_totalprice").cast("bigint").alias("bytes"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("last_used"))
    return retention.evict(c, 500_000_000, c.filter("key % 10 = 0")).select("key", "bytes")


@query("w9_w10_nth_and_ordinal", "SELECT o_orderkey, o_orderpriority || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS name, ordinal FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal FROM orders)")
def w9(spark, d):
    n = F.row_number().over(W.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey"))
    x = table(spark, d, "orders").withColumn("n", n).withColumn("ordinal", (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("bigint"))
    return x.select("o_orderkey", F.concat("o_orderpriority", F.when(F.col("n") > 1, F.concat(F.lit("#"), F.col("n"))).otherwise("")).alias("name"), "ordinal")


@query("w11_previous_end", with_("obs") + "SELECT session_id, received_seq, lag(at_ms) OVER (PARTITION BY session_id ORDER BY at_ms, received_seq) AS previous FROM obs")
def w11(spark, d):
    return observations(spark, d).select("session_id", "received_seq", F.lag("at_ms").over(W.partitionBy("session_id").orderBy("at_ms", "received_seq")).alias("previous"))


@query("w12_latest_run", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def w12(spark, d):
    x = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return x.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("r")).select("o_custkey", "r.o_orderkey", "r.o_totalprice")


@query("w13_stuck_generations", "WITH g AS (SELECT *, max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS top FROM orders) SELECT o_orderkey AS generation_id, top AS active_number FROM g WHERE o_orderstatus <> 'O' AND o_orderkey > coalesce(top, -1)")
def w13(spark, d):
    g = table(spark, d, "orders").select(F.col("o_orderkey").alias("generation_id"), F.col("o_custkey").alias("worktree_id"), F.col("o_orderkey").alias("number"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("failed").alias("state"))
    return retention.stuck_generations(g).select("generation_id", "active_number")


@query("w14_next_audit_version", with_("mem") + "SELECT entry_id, conv_id, coalesce(max(entry_version) OVER (PARTITION BY conv_id), 0) + row_number() OVER (PARTITION BY conv_id ORDER BY created_at, entry_id) AS version FROM mem")
def w14(spark, d):
    m = entries(spark, d).withColumn("idempotency_key", F.col("entry_id").cast("string")).withColumn("last_version", F.max("entry_version").over(W.partitionBy("conv_id")))
    return ledger.audit(m, "conv_id", "created_at").select("entry_id", "conv_id", F.col("version").cast("bigint").alias("version"))


# ---- predicates, paging and sets


@query("p7_p8_scope_filter", with_("mem") + "SELECT entry_id, kind FROM mem WHERE scope_kind = 'repo' AND scope_owner = 2 AND state NOT IN ('resolved', 'retracted', 'rejected', 'superseded') AND canonical_key = 'k7'")
def p7(spark, d):
    return ledger.in_scope(entries(spark, d), "repo", 2, "k7").select("entry_id", "kind")


@query("p13_ids_in_order", "SELECT page_id, url, (vec_id * 37) % 1000003 AS pos FROM embeddings JOIN pages ON page_id = vec_id ORDER BY pos")
def p13(spark, d):
    from tessera.operators.lexical import in_order

    asked = table(spark, d, "embeddings").select(F.col("vec_id").alias("page_id"), (F.col("vec_id") * 37 % 1_000_003).alias("pos"))
    return in_order(table(spark, d, "pages").select("page_id", "url"), asked, "page_id")


@query("p14_exists", with_("obs", rest=_CURSORS) + "SELECT session_id, bool_or(event_type = 'error' AND received_seq > coalesce(last_seq, 0)) AS checkpoint FROM obs LEFT JOIN cur USING (session_id) GROUP BY session_id")
def p14(spark, d):
    o = observations(spark, d)
    late = F.col("received_seq") > F.coalesce("last_seq", F.lit(0))
    return o.join(_cursors(o), "session_id", "left").groupBy("session_id").agg(F.max((F.col("event_type") == "error") & late).alias("checkpoint"))


@query("p15_expired", f"SELECT event_id, epoch_us(ts) // 1000 AS at_ms FROM events WHERE {NOW} - epoch_us(ts) // 1000 >= 3888000000")
def p15(spark, d):
    x = table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return retention.expired(x, "at_ms", "candidate", NOW - 15 * 86_400_000)


@query("l4_l5_page", with_("mem") + "SELECT entry_id, kind, (SELECT count(*) FROM mem WHERE scope_kind = 'repo' AND scope_owner = 2) AS total, (SELECT count(*) FROM mem WHERE scope_kind = 'repo' AND scope_owner = 2) > 25 AS has_more FROM mem WHERE scope_kind = 'repo' AND scope_owner = 2 ORDER BY created_at, entry_id LIMIT 20 OFFSET 5")
def l4(spark, d):
    return ledger.list_entries(entries(spark, d), [("repo", 2)], offset=5).select("entry_id", "kind", F.col("total").cast("bigint").alias("total"), "has_more")


@query("l5_limits", with_("mem") + "SELECT entry_id, (SELECT count(*) FROM mem WHERE scope_kind IN ('repo', 'global') AND scope_owner IN (0, 2) AND (scope_kind, scope_owner) IN (('repo', 2), ('global', 0))) AS total FROM mem WHERE (scope_kind, scope_owner) IN (('repo', 2), ('global', 0)) ORDER BY created_at, entry_id LIMIT 100")
def l5(spark, d):
    """A page that asks for more than a call may get."""
    return ledger.list_entries(entries(spark, d), [("repo", 2), ("global", 0)], limit=5000).select("entry_id", F.col("total").cast("bigint").alias("total"))


@query("l6_u2_scope_union", with_("mem") + "SELECT DISTINCT entry_id, kind FROM mem WHERE state NOT IN ('resolved', 'retracted', 'rejected', 'superseded') AND ((scope_kind = 'global' AND scope_owner = 0) OR (scope_kind = 'repo' AND scope_owner = 2) OR (scope_kind = 'worktree' AND scope_owner = 1)) ORDER BY entry_id LIMIT 20000")
def l6(spark, d):
    return ledger.scopes_union(entries(spark, d), [("global", 0), ("repo", 2), ("worktree", 1), ("repo", 2)]).select("entry_id", "kind")


@query("u1_union_distinct", "SELECT source AS name FROM documents UNION SELECT lang FROM documents UNION SELECT role FROM conversations")
def u1(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("source").alias("name")).union(docs.select("lang")).union(table(spark, d, "conversations").select("role")).distinct()


@query("u3_difference", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def u3(spark, d):
    seen = table(spark, d, "labels").select("doc_id").union(table(spark, d, "embeddings").select("vec_id"))
    return table(spark, d, "documents").select("doc_id").join(seen, "doc_id", "left_anti")
