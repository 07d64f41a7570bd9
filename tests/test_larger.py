"""Queries against their SQL over tables that hold what only larger ones of the driver do."""

import hashlib
import os
import tracemalloc

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import dense, lexical
from tessera.plans import catalog
from tessera.sources import spool

D = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """A folder of the smallest tables, in which some may be put in the place of others."""
    root = tmp_path / "tables"
    root.mkdir()
    for f in os.listdir(D):
        (root / f).symlink_to(f"{D}/{f}")

    def put(df, name):
        (root / f"{name}.parquet").unlink()
        df.toPandas().to_parquet(root / f"{name}.parquet", index=False, coerce_timestamps="us")
        return str(root)

    return put


def agrees(spark, name, d):
    same(catalog.QUERIES[name](spark, d), catalog.SQL[name], d)


def test_last_lines_about_the_limit_of_a_piece(spark, tables):
    texts = [head + "x" * n + end for head in ("", "ab\n") for n in (2047, 2048, 2049, 2050) for end in ("", "\n")]
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
    agrees(spark, "c4_oversize_lines", tables(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "documents"))


@pytest.mark.parametrize("name", ["m_apply_plan", "m_apply_plan_audits", "m_apply_plan_entries"])
def test_plan_where_ids_are_far_apart(spark, tables, name):
    """Entries ten million apart: the id at which a created one is shown is that of an entry."""
    rows = [(c, t, r, f"{c} {t}") for c in (3, 4, 10_003, 10_004, 20_003) for t, r in enumerate(("user", "assistant", "user"))]
    agrees(spark, name, tables(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conversations"))


def test_ages_of_hours_and_days(spark, tables):
    events = spark.read.parquet(f"{D}/events.parquet").limit(300)
    agrees(spark, "f16_f18_f19_scalars", tables(events.withColumn("user_id", F.col("event_id") * 977), "events"))
    ages = spark.sql("select explode(array(0, 59, 3599, 12300, 532800)) as s").select(fx.humanized_age(F.col("s") * 1000).alias("a"), fx.humanized_age(F.col("s") * 1000, "h").alias("b"), fx.humanized_age(F.col("s") * 1000, "m").alias("c"))
    assert [tuple(r) for r in ages.collect()][2:] == [("59m ago",) * 3, ("3h 25m ago", "3h 25m ago", "205m ago"), ("6d 4h ago", "148h 0m ago", "8880m ago")]


# ---- spool segments


def segment(payloads):
    sums = spool.crc32c(payloads).tolist()
    return spool.MAGIC + b"\x01\x00" + bytes(10) + b"".join(len(p).to_bytes(4, "little") + c.to_bytes(4, "little") + p for p, c in zip(payloads, sums))


def test_small_segments_share_tasks(spark, tmp_path):
    """Two thousand segments in ranges smaller than they are: tasks grow with the bytes, not with the ranges."""
    for s in range(4):
        (tmp_path / str(s)).mkdir()
        for n in range(500):
            (tmp_path / str(s) / f"{n + 1:06}.seg").write_bytes(segment([b"%d %d %d" % (s, n, i) for i in range(5)]))
    frames = spool.read_spool(spark, str(tmp_path), width=32)
    assert frames.rdd.getNumPartitions() <= 8
    got = sorted((r.session, r.segment, bytes(r.payload)) for r in frames.collect())
    assert got == sorted((str(s), n + 1, b"%d %d %d" % (s, n, i)) for s in range(4) for n in range(500) for i in range(5))


def test_ranges_of_a_segment_one_by_one(tmp_path):
    payloads = [b"x" * n for n in (0, 1, 200, 7, 90, 33)]
    (tmp_path / "a").mkdir()
    path = tmp_path / "a" / "000001.seg"
    path.write_bytes(segment(payloads))
    for width in (5, 16, 64, 1000):
        ranges = [spool.Segment("a", 1, str(path), a, a + width, 0) for a in range(0, path.stat().st_size, width)]
        got = [b for r in ranges for batch in spool._read(str(tmp_path), [r]) for b in batch.column("payload").to_pylist()]
        assert got == payloads
        assert [len(p.parts) for p in spool.dealt((r, width) for r in ranges)] == [1]


def test_envelopes_are_parsed_once(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "000001.seg").write_bytes(segment([b"{}"]))
    plan = spool.parsed(spool.read_spool(spark, str(tmp_path))).filter("status <> 'ok'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


# ---- vectors


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_a_task_holds_few_scores(metric):
    """A chunk and a block as large as they come: all of their scores would take half a gigabyte, several times over."""
    r = np.random.default_rng(1)
    x, q = r.integers(-4, 5, (dense.CHUNK, 8)).astype(float), r.integers(-4, 5, (dense.BLOCK, 8)).astype(float)
    tracemalloc.start()
    found = dense._nearest(x, np.arange(len(x)), q, np.arange(len(q)), metric, 5, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20, peak
    for j in (0, 63, 64, 65, 4095):
        norms = np.linalg.norm(x, axis=1) * np.linalg.norm(q[j])
        s = {"l2": -np.sqrt(((x - q[j]) ** 2).sum(1)), "dot": x @ q[j], "cosine": np.where(norms > 0, x @ q[j] / np.where(norms > 0, norms, 1), 0)}[metric]
        s = np.round(s, 6) + 0.0
        asked, ids, scores = found[j]
        assert set(asked.tolist()) == {j} and ids.tolist() == np.lexsort((np.arange(len(x)), -s))[:5].tolist() and scores.tolist() == s[ids].tolist()


# ---- streams


def test_payloads_of_a_group_are_read_together(spark, monkeypatch):
    """Calls to the state don't grow with the payloads of a group, and a payload that is due when the watermark comes to its time is due."""
    import pandas as pd

    from tessera.streaming import stateful

    calls, held, timers = [], [], []

    class List:
        def get(self):
            calls.append("get")
            return iter(list(held))

        def appendList(self, rows):
            calls.append("append")
            held.extend(rows)

        def put(self, rows):
            calls.append("put")
            held[:] = rows

        def clear(self):
            calls.append("clear")
            held.clear()

    class Handle:
        getListState = staticmethod(lambda *a: List())
        listTimers = staticmethod(lambda: iter(list(timers)))
        registerTimer, deleteTimer = timers.append, timers.remove

    class Now:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at

    p = stateful._Payloads(100)
    p.init(Handle())
    rows = lambda start, n: iter([pd.DataFrame({"session_id": ["a", "b"] * n, "id": [str(start + k) for k in range(2 * n)], "at": range(start, start + 2 * n)})])
    assert sum(map(len, p.handleInputRows(("x",), rows(0, 500), None))) == 1000 and timers == [99]
    assert sum(map(len, p.handleInputRows(("x",), rows(990, 10), None))) == 10, "ten came again"
    timers.clear()  # as one does that fires
    gone = list(p.handleExpiredTimer(("x",), Now(700), Now(99)))[0]
    assert gone["at_ms"].tolist() == list(range(100, 701)) and timers == [700] and len(held) == 1010 - 601
    assert len(calls) <= 6


# ---- files


def test_files_too_large_to_read_are_listed(spark, tmp_path):
    from tessera.sources import files

    (tmp_path / "small.txt").write_bytes(b"small")
    (tmp_path / "few.bin").write_bytes(bytes(range(256)) * 40_000)  # more than one read
    for name in ("large.bin", ".large"):
        with open(tmp_path / name, "wb") as f:
            f.truncate(3 << 30)  # no blocks on disk
    want = {"small.txt": hashlib.sha256(b"small").hexdigest(), "few.bin": hashlib.sha256(bytes(range(256)) * 40_000).hexdigest(), "large.bin": None, ".large": None}
    before = files.scan(spark, str(tmp_path), max_bytes=1 << 30).persist()
    assert {r.path: r.content_hash for r in before.collect()} == want
    again = files.rescan(spark, str(tmp_path), before.filter("path <> 'few.bin'"), max_bytes=1 << 30)
    assert {r.path: (r.content_hash, r.reused) for r in again.collect()} == {k: (v, k == "small.txt") for k, v in want.items()}


# ---- words


def test_pairs_of_queries_and_documents_stay_in_tasks(spark):
    """All documents share a term with all queries: what leaves the tasks are the best of each query, ties among them by the smaller id."""
    docs = spark.range(1500).selectExpr("id as doc_id", "concat(array('all'), transform(sequence(0, cast(id % 7 as int)), x -> concat('w', (id + x) % 50))) as body")
    queries = spark.range(40).selectExpr("if(id = 0, null, id) as query_id", "array('all', 'none', concat('w', id), concat('w', (id * 3) % 50)) as tokens")
    leg = lexical.lexical_leg(docs, queries, {"body": "body"}, 5, digits=6)
    want = lexical.top(lexical.lexical_scores(docs, queries, {"body": "body"}, digits=6), lexical.depth(5))
    row = lambda df: sorted(((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)
    assert row(leg) == row(want) and leg.count() == 40 * 50
    plan = leg._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sum(" not in plan.split("MapInArrow")[0]


@pytest.mark.parametrize("cells", [1, 90, 1 << 20])
def test_scores_of_some_queries_at_a_time(monkeypatch, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    r = np.random.default_rng(2)
    held = r.random((30, 12)) < 0.4
    docs, codes = np.nonzero(held)
    weights, idf = r.integers(1, 4, len(docs)).astype(float), r.integers(1, 3, 12).astype(float)
    terms = [sorted(r.choice(12, n, replace=False)) for n in (1, 5, 12, 3, 2)]
    flat = np.concatenate(terms)
    asked = {"first": np.append(0, np.cumsum([len(t) for t in terms])), "codes": flat, "idf": idf[flat], "terms": list(range(12))}
    dense_weights = np.zeros((30, 12))
    dense_weights[docs, codes] = weights
    got = list(lexical._best(docs, codes, weights, np.arange(100, 130), asked, 4, 6))
    assert len(got) == len(terms)
    for j, (places, ids, scores) in enumerate(got):
        s = dense_weights[:, terms[j]] @ idf[terms[j]]
        want = [i for i in np.lexsort((np.arange(30), -s)) if s[i] > 0][:4]
        assert set(places.tolist()) == {j} and (ids - 100).tolist() == want and scores.tolist() == s[want].tolist()
