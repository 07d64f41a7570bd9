"""Retrieval queries: lexical, dense, fused, recalled and evaluated."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import dense, evaluate, fusion, ledger, lexical
from tessera.plans.views import entries, files, with_
from tessera.session import table

Q, SQL = {}, {}
FIELDS = {f: f"{f}_tokens" for f in ("name", "qualified_name", "path", "signature", "body")}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def corpus(spark, d):
    """Documents with the tokens of all five fields."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return files(spark, d).select(
        "doc_id", "lang", fx.identifier_tokens(name).alias("name_tokens"), fx.qualified_tokens(F.concat_ws(".", "source", "lang", name)).alias("qualified_name_tokens"), fx.path_tokens(F.col("path")).alias("path_tokens"),
        fx.signature_tokens(F.concat(F.lit("fn "), "lang", F.lit("_"), "source", F.lit("("), name, F.lit(")"))).alias("signature_tokens"), fx.body_tokens(F.col("text")).alias("body_tokens"),
    )


def questions(spark, d):
    """Benchmark items as queries."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), fx.body_tokens(F.col("text")).alias("tokens"))


def _bm25(docs: str, asked: str, id: str = "doc_id") -> str:
    """The ranking of `docs` (id, weights, tokens as toks, length as len) for the queries in `asked` (query_id, text), as SQL."""
    return docs + r""",
size AS (SELECT count(*) AS n, avg(length) AS avg_length FROM len),
post AS (SELECT {id}, term, sum(w) AS wtf FROM toks GROUP BY {id}, term), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM {asked}),
qd AS (SELECT query_id, qt.term, coalesce(df, 0) AS df FROM qt LEFT JOIN df USING (term)),
qr AS (SELECT *, df <= (SELECT n // 2 FROM size) AS ok, bool_or(df <= (SELECT n // 2 FROM size)) OVER (PARTITION BY query_id) AS anyok, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS nth FROM qd),
sel AS (SELECT query_id, term, df FROM qr WHERE ok OR (NOT anyok AND nth = 1)),
sc AS (SELECT query_id, p.{id}, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * wtf * 2.2::DOUBLE / (wtf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length))), 6) AS score
  FROM post p JOIN sel USING (term) JOIN len USING ({id}) CROSS JOIN size GROUP BY query_id, p.{id}),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {id}) AS rank FROM sc),
leg AS (SELECT * FROM lex WHERE rank <= 50)""".replace("{id}", id).replace("{asked}", asked)


_TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_CORPUS = _bm25(
    r"""docs AS (SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS i, 'd' || doc_id AS di, regexp_extract(source, '^[a-z]+') AS sa, regexp_extract(source, '[0-9]+$') AS sn, source, (['md','py','json','rs','txt'])[CAST(doc_id % 5 AS INTEGER) + 1] AS ext, text FROM files),
fields AS (SELECT doc_id, [di, 'd', i] AS nt, [source, sa, sn, lang, di, 'd', i] AS qt, [source, sa, sn, lang, 'd', i, ext] AS pt, list_distinct(['fn', lang, sa, sn, di, 'd', i]) AS st, """ + _TOKENS + r""" AS bt FROM docs),
toks AS (SELECT doc_id, unnest(nt) AS term, 4.0::DOUBLE AS w FROM fields UNION ALL SELECT doc_id, unnest(qt), 3.0 FROM fields UNION ALL SELECT doc_id, unnest(pt), 1.5 FROM fields UNION ALL SELECT doc_id, unnest(st), 2.0 FROM fields UNION ALL SELECT doc_id, unnest(bt), 1.0 FROM fields),
len AS (SELECT doc_id, len(nt) + len(qt) + len(pt) + len(st) + len(bt) AS length FROM fields), bench AS (SELECT item_id AS query_id, text FROM benchmark)""", "bench",
)


def _leg(spark, d, limit=10):
    return lexical.lexical_leg(corpus(spark, d), questions(spark, d), FIELDS, limit, digits=6)


@query("a19_document_frequency", with_("files", rest=_CORPUS) + "SELECT term, df FROM df WHERE df >= 20")
def a19(spark, d):
    return lexical.document_frequency(lexical.postings(corpus(spark, d), FIELDS)).filter("df >= 20")


@query("r5_query_terms", with_("files", rest=_CORPUS) + "SELECT query_id, term, df FROM sel")
def r5(spark, d):
    q = questions(spark, d)
    posts = lexical.asked_postings(corpus(spark, d), FIELDS, q.select(F.explode_outer("tokens").alias("term"))).persist()
    return lexical.select_terms(q, lexical.document_frequency(posts), posts.filter("term is null").count())


@query("r7_r8_bm25_leg", with_("files", rest=_CORPUS) + "SELECT query_id, doc_id, score, rank FROM leg")
def r7(spark, d):
    return _leg(spark, d).select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("r6_p12_name_pattern", with_("files", rest=_CORPUS) + "SELECT doc_id FROM fields WHERE len(list_filter(['src1', 'd1'], lambda p: len(list_filter(list_concat(nt, qt), lambda t: starts_with(t, p))) = 0)) = 0")
def r6(spark, d):
    return corpus(spark, d).filter(lexical.name_matches(F.array(F.lit("src1"), F.lit("d1")), F.col("name_tokens"), F.col("qualified_name_tokens"))).select("doc_id")


_DENSE = """qv AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
dsc AS (SELECT query_id, vec_id AS doc_id, {score} AS score FROM embeddings, qv), den AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dsc)"""
_COS = "round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))), 6) + 0.0"


def _nearest(spark, d, k, metric):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return dense.nearest(e, q, k, metric).select("query_id", F.col("vec_id").alias("doc_id"), "score", F.col("rank").cast("bigint").alias("rank"))


@query("r9_r10_knn_cosine", "WITH " + _DENSE.format(score=_COS) + " SELECT query_id, doc_id, score, rank FROM den WHERE rank <= 20")
def r10(spark, d):
    return _nearest(spark, d, 20, "cosine")


@query("r9_r10_knn_dot", "WITH " + _DENSE.format(score="round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]), 6) + 0.0") + " SELECT query_id, doc_id, score, rank FROM den WHERE rank <= 20")
def r10_dot(spark, d):
    return _nearest(spark, d, 20, "dot")


@query("r9_r10_knn_l2", "WITH " + _DENSE.format(score="round(-list_distance(embedding::DOUBLE[], q::DOUBLE[]), 6) + 0.0") + " SELECT query_id, doc_id, score, rank FROM den WHERE rank <= 20")
def r10_l2(spark, d):
    return _nearest(spark, d, 20, "l2")


@query("l3_filtered_knn", "WITH qv AS (SELECT vec_id AS query_id, embedding AS q, label AS mine FROM embeddings WHERE vec_id % 20 = 0), dsc AS (SELECT query_id, vec_id AS doc_id, " + _COS + " AS score FROM embeddings, qv WHERE label = mine OR label = mine + 1 OR query_id % 3 = 0), den AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dsc) SELECT query_id, doc_id, score, rank FROM den WHERE rank <= 20")
def l3(spark, d):
    """Vectors of two labels each; every third query asks for all."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    kinds = F.when(F.col("vec_id") % 3 != 0, F.array("label", F.col("label") + 1))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), kinds.alias("kinds"))
    return dense.nearest(e, q, 20, kind="label", kinds="kinds").select("query_id", F.col("vec_id").alias("doc_id"), "score", F.col("rank").cast("bigint").alias("rank"))


_HYBRID = """dq AS (SELECT item_id AS query_id, embedding AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
dsc AS (SELECT query_id, vec_id AS doc_id, """ + _COS + """ AS score FROM embeddings, dq), dleg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dsc) WHERE rank <= 50),
fu AS (SELECT coalesce(l.query_id, x.query_id) AS query_id, coalesce(l.doc_id, x.doc_id) AS doc_id, l.rank AS lexical_rank, x.rank AS dense_rank,
  round(coalesce((1 - 61.0::DOUBLE / 62.0::DOUBLE) / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0), 9) AS score FROM leg l FULL JOIN dleg x ON l.query_id = x.query_id AND l.doc_id = x.doc_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fu)"""


def _hybrid(spark, d, limit=10, leg=None, mode="hybrid"):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")).join(e, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    near = dense.nearest(e, q, lexical.depth(limit)).withColumnRenamed("vec_id", "doc_id")
    return fusion.search(_leg(spark, d, limit) if leg is None else leg, near, limit, mode)[0]


@query("r11_j13_hybrid_search", with_("files", rest=_CORPUS + ", " + _HYBRID) + "SELECT query_id, doc_id, lexical_rank, dense_rank, score, rank FROM fr WHERE rank <= 10")
def r11(spark, d):
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return _hybrid(spark, d).select("query_id", "doc_id", big("lexical_rank"), big("dense_rank"), "score", big("rank"))


@query("r13_r14_lexical_only", with_("files", rest=_CORPUS) + "SELECT query_id, doc_id, rank, 'lexical_only' AS answered FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round((1 - 61.0::DOUBLE / 62.0::DOUBLE) / (60 + rank), 9) DESC, doc_id) AS rank FROM leg) WHERE rank <= 10")
def r13(spark, d):
    hits, how = fusion.search(_leg(spark, d), None, 10)
    return hits.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.lit(how).alias("answered"))


@query("r13_dense_only", with_("files", rest=_CORPUS + ", " + _HYBRID) + "SELECT query_id, doc_id, dense_rank, rank FROM (SELECT query_id, doc_id, rank AS dense_rank, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0::DOUBLE / (60 + rank), 9) DESC, doc_id) AS rank FROM dleg) WHERE rank <= 10")
def r13d(spark, d):
    big = lambda c: F.col(c).cast("bigint").alias(c)
    leg = spark.createDataFrame([], "query_id long, doc_id long, rank int")  # the mode leaves it aside
    return _hybrid(spark, d, leg=leg, mode="code").select("query_id", "doc_id", big("dense_rank"), big("rank"))


@query("r15_enrichment", with_("files", rest=_CORPUS + ", " + _HYBRID) + "SELECT query_id, fr.doc_id, rank, path FROM fr JOIN files f ON fr.doc_id = f.doc_id WHERE rank <= 10 AND f.doc_id % 7 <> 0")
def r15(spark, d):
    found, _ = fusion.enrich(_hybrid(spark, d), files(spark, d).filter("doc_id % 7 <> 0"))
    return found.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), "path")


@query("r16_snippets", """WITH s AS (SELECT doc_id, strlen(text) AS size, doc_id % 40 AS start, substr(hex(encode(text)), 2 * (doc_id % 40) + 1) AS x FROM documents),
g AS (SELECT *, start <= size AND NOT regexp_matches(x, '^[89AB]') AS good FROM s)
SELECT doc_id, CASE WHEN good THEN decode(unhex(CASE WHEN length(x) > 16384 THEN regexp_replace(substr(x, 1, 16384), '([CD].|E.([89AB].)?|F.([89AB].){0,2})$', '') ELSE x END)) END AS text,
       CASE WHEN good THEN CAST(size - start AS BIGINT) END AS full_bytes, CASE WHEN good THEN sha256(unhex(x)) END AS full_hash, CASE WHEN good THEN size - start > 8192 END AS truncated FROM g""")
def r16(spark, d):
    rows = files(spark, d).select("doc_id", "text", (F.col("doc_id") % 40).cast("int").alias("start"), F.octet_length("text").alias("end"))
    return fusion.with_snippets(rows).select("doc_id", "snippet.*")


@query("r17_file_context", with_("files") + """SELECT path, doc_id AS id, CAST(0 AS INTEGER) AS start, CAST(strlen(text) AS INTEGER) AS "end", NULL AS reason FROM files WHERE path = (SELECT min(path) FROM files WHERE doc_id % 3 <> 0)
UNION ALL SELECT path, NULL, NULL, NULL, 'huge' FROM files WHERE path = (SELECT max(path) FROM files WHERE doc_id % 3 = 0)""")
def r17(spark, d):
    f = files(spark, d)
    units = f.filter("doc_id % 3 <> 0").select("path", F.col("doc_id").alias("id"), F.lit(0).alias("start"), F.octet_length("text").alias("end"))
    skipped = f.filter("doc_id % 3 = 0").select("path", F.lit("huge").alias("reason"))
    indexed, not_indexed = units.agg(F.min("path")).first()[0], skipped.agg(F.max("path")).first()[0]
    return fusion.file_context(units, skipped, indexed).unionByName(fusion.file_context(units, skipped, not_indexed))


@query("r18_overview_tree", with_("files", rest="""p AS (SELECT string_split(path, '/') AS s FROM files), x AS (SELECT unnest(range(0, least(len(s) - 1, 3) + 1)) AS depth, s FROM p)""") + "SELECT depth, array_to_string(s[1:depth], '/') AS directory, count(*) AS files, count(*) AS occurrences FROM x GROUP BY ALL")
def r18(spark, d):
    from tessera.operators.stats import directory_rollup

    f = files(spark, d).withColumn("one", F.lit(1).cast("bigint"))
    return directory_rollup(f, occurrences="one").select(F.col("depth").cast("bigint").alias("depth"), "directory", "files", "occurrences")


_ENTRIES = _bm25(
    "cand AS (SELECT entry_id, text, created_at, conv_id FROM mem WHERE state NOT IN ('resolved', 'retracted', 'rejected', 'superseded')), words AS (SELECT entry_id, " + _TOKENS + " AS bt FROM cand), "
    "toks AS (SELECT entry_id, unnest(bt) AS term, 1.0::DOUBLE AS w FROM words), len AS (SELECT entry_id, len(bt) AS length FROM words), asked AS (SELECT entry_id AS query_id, text FROM cand WHERE {which})", "asked", "entry_id",
)


def _live(spark, d):
    return entries(spark, d).filter(~F.col("state").isin(*ledger.TERMINAL)).select("entry_id", "text", "created_at", "conv_id", fx.body_tokens(F.col("text")).alias("body_tokens"))


@query("r20_recall_lexical", with_("mem", rest=_ENTRIES.replace("{which}", "entry_id % 20 = 0")) + "SELECT query_id, entry_id, score, rank FROM leg")
def r20(spark, d):
    c = _live(spark, d)
    q = c.filter("entry_id % 20 = 0").select(F.col("entry_id").alias("query_id"), F.col("body_tokens").alias("tokens"))
    return lexical.lexical_leg(c, q, {"body": "body_tokens"}, 10, "entry_id", digits=6).select("query_id", "entry_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("r21_recall_dense", with_("mem", rest="c AS (SELECT entry_id, embedding FROM mem JOIN embeddings ON vec_id = conv_id WHERE state NOT IN ('resolved', 'retracted', 'rejected', 'superseded')), q AS (SELECT entry_id AS query_id, embedding AS q FROM c WHERE entry_id % 20 = 0), s AS (SELECT query_id, entry_id, " + _COS + " AS score FROM c, q)") + "SELECT query_id, entry_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM s) WHERE rank <= 10")
def r21(spark, d):
    """Only entries whose text has a vector are scored."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    c = _live(spark, d).join(vectors, "conv_id").select("entry_id", "embedding")
    q = c.filter("entry_id % 20 = 0").select(F.col("entry_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return dense.nearest(c, q, 10, id="entry_id").select("query_id", "entry_id", "score", F.col("rank").cast("bigint").alias("rank"))


_RECALL = _ENTRIES.replace("{which}", "entry_id = (SELECT max(entry_id) FROM cand)").replace("rank <= 50", "rank <= 1000000000") + """,
dv AS (SELECT entry_id, """ + _COS + """ AS score FROM (SELECT entry_id, embedding FROM cand JOIN embeddings ON vec_id = conv_id), (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))),
dx AS (SELECT entry_id, row_number() OVER (ORDER BY score DESC, entry_id) AS rank FROM dv),
sco AS (SELECT c.*, round(coalesce(1.0::DOUBLE / (60 + leg.rank), 0) + coalesce(1.0::DOUBLE / (60 + dx.rank), 0), 9) AS score, CAST(ceil(length(text) / 4.0) + 8 AS BIGINT) AS cost FROM cand c LEFT JOIN leg USING (entry_id) LEFT JOIN dx USING (entry_id)),
sp AS (SELECT *, sum(cost) OVER w AS spent, row_number() OVER w AS rank FROM sco WINDOW w AS (ORDER BY score DESC, created_at DESC, entry_id ROWS UNBOUNDED PRECEDING))"""


@query("r12_r19_r22_w5_recall", with_("mem", rest=_RECALL) + "SELECT entry_id, score, cost, CAST(spent AS BIGINT) AS spent, rank FROM sp WHERE spent <= 4000")
def r19(spark, d):
    """Both legs over all candidates, fused, in order and cut to the budget: the newest entry's text and one vector ask."""
    c = _live(spark, d).persist()
    newest = c.agg(F.max_by(F.struct("entry_id", "body_tokens"), "entry_id").alias("m")).select(F.col("m.entry_id").alias("query_id"), F.col("m.body_tokens").alias("tokens"))
    best = (F.desc("score"), F.asc("entry_id"))
    lx = fusion.placed(lexical.lexical_scores(c, newest, {"body": "body_tokens"}, "entry_id", digits=6).select("entry_id", "score"), *best)
    e = table(spark, d, "embeddings")
    asked = e.agg(F.min_by("embedding", "vec_id").alias("asked"))  # one vector
    scored = c.join(e.select(F.col("vec_id").alias("conv_id"), "embedding"), "conv_id").join(F.broadcast(asked))
    dx = fusion.placed(scored.select("entry_id", (F.round(dense.cosine(F.col("embedding"), F.col("asked")), 6) + 0.0).alias("score")), *best)
    out = fusion.recall(c.select("entry_id", "text", "created_at"), lx, dx, 4000, fx.token_estimate(F.col("text")), fresh=entries(spark, d).select("entry_id", "state", "text"))
    return out.select("entry_id", "score", "cost", "spent", F.col("rank").cast("bigint").alias("rank"))


@query("r24_r25_backfill")
def r24(spark, d):
    f = files(spark, d).select(F.sha2("text", 256).alias("subject_hash"), "text", "doc_id")
    cached = f.filter("doc_id % 3 = 0").select("subject_hash", dense.encode_le(dense.embed(F.col("text"))).alias("blob"), F.lit(256).alias("dimensions"), "doc_id")
    cached = cached.withColumn("checksum", F.when(F.col("doc_id") % 9 == 0, F.lit("bad")).otherwise(F.sha2("blob", 256)))
    return dense.backfill(f, cached).select("subject_hash", F.sha2(dense.encode_le(F.col("embedding")), 256).alias("vector_sha256"))


@query("r26_r27_expected_points", with_("files") + "SELECT DISTINCT doc_id, kind, CASE kind WHEN 'code_raw' THEN sha256(text) ELSE sha256(path) END AS subject FROM files, (VALUES ('code_raw'), ('code_context')) v(kind)")
def r26(spark, d):
    kinds = F.explode(F.array(F.lit("code_raw"), F.lit("code_context"))).alias("kind")
    return files(spark, d).select("doc_id", "text", "path", kinds).select("doc_id", "kind", F.when(F.col("kind") == "code_raw", F.sha2("text", 256)).otherwise(F.sha2("path", 256)).alias("subject")).distinct()


@query("r28_validation_ladder", with_("files") + """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing_head' WHEN doc_id % 7 = 0 THEN 'generation' WHEN doc_id % 5 = 0 THEN 'schema_version' WHEN doc_id % 13 = 0 THEN 'count' END AS divergence FROM files""")
def r28(spark, d):
    from tessera.operators.stats import divergence

    i = F.col("doc_id")
    heads = files(spark, d).select(
        "doc_id", F.lit("g").alias("generation"), F.when(i % 11 != 0, F.when(i % 7 == 0, "old").otherwise("g")).alias("head_generation"), F.lit(2).alias("schema"), F.when(i % 5 == 0, 1).otherwise(2).alias("head_schema"),
        F.lit(1).alias("tokenizer"), F.lit(1).alias("head_tokenizer"), F.lit(10).alias("count"), F.when(i % 13 == 0, 9).otherwise(10).alias("head_count"), F.lit("m").alias("manifest"), F.lit("m").alias("head_manifest"),
    )
    return divergence(heads).select("doc_id", "divergence")


# ---- evaluation


@query("a20_ir_metrics", with_("files", rest=_CORPUS + ", " + _HYBRID + """, rel AS (SELECT query_id, min(doc_id) AS doc_id FROM leg GROUP BY query_id),
rk AS (SELECT r.query_id, (SELECT min(rank) FROM fr WHERE fr.query_id = r.query_id AND fr.doc_id = r.doc_id AND rank <= 10) AS rank FROM rel r)""") + """SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5 FROM rk""")
def a20(spark, d):
    leg = _leg(spark, d).persist()
    relevant = leg.groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    return evaluate.retrieval(evaluate.ranks(_hybrid(spark, d, leg=leg), relevant))


@query("a21_ir_metrics_by_group", with_("files", rest=_CORPUS + """, rel AS (SELECT query_id, max(doc_id) AS doc_id FROM leg GROUP BY query_id), rk AS (SELECT r.query_id, r.query_id % 3 AS grp, (SELECT min(rank) FROM leg WHERE leg.query_id = r.query_id AND leg.doc_id = r.doc_id) AS rank FROM rel r)""") + """SELECT grp, count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5 FROM rk GROUP BY grp""")
def a21(spark, d):
    leg = _leg(spark, d)
    relevant = leg.groupBy("query_id").agg(F.max("doc_id").alias("doc_id"))
    return evaluate.retrieval(evaluate.ranks(leg, relevant).withColumn("grp", F.col("query_id") % 3), "grp")


@query("a22_multiset_prf", """WITH e AS (SELECT user_id % 40 AS c, event_type AS k, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id % 40 AS c, CASE WHEN event_id % 7 = 0 THEN 'view' ELSE event_type END AS k, count(*) AS n FROM events GROUP BY ALL),
b AS (SELECT coalesce(e.c, p.c) AS c, coalesce(e.n, 0) AS e, coalesce(p.n, 0) AS p FROM e FULL JOIN p ON e.c = p.c AND e.k = p.k), s AS (SELECT c, sum(e) AS e, sum(p) AS p, sum(least(e, p)) AS tp, min(CASE WHEN e = p THEN 1 ELSE 0 END) AS x FROM b GROUP BY c)
SELECT round(sum(tp)::DOUBLE / sum(p), 6) AS precision, round(sum(tp)::DOUBLE / sum(e), 6) AS recall, round(2.0 * sum(tp)::DOUBLE / (sum(e) + sum(p)), 6) AS f1, round(avg(x), 6) AS exact_match FROM s""")
def a22(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 40).alias("case_id"), F.col("event_type").alias("kind"))
    return evaluate.routing(e, e.withColumn("kind", F.when(F.col("event_id") % 7 == 0, "view").otherwise(F.col("kind"))))


@query("a23_gate", "SELECT event_id, round((0.7 - value / 1000.0::DOUBLE) * 1e4) <= round((event_id % 5) * 0.1::DOUBLE * 1e4) AS passed FROM events")
def a23(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", evaluate.gated(F.col("value") / 1000, F.lit(0.7), F.col("event_id") % 5 * F.lit(0.1)).alias("passed"))
