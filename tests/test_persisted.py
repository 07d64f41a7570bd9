"""What the engine stores in formats of its own, against plain Python."""

import glob
import json
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import deletion, generations, index, lexical, retention, shard
from tessera.sources import spool


def envelope(n, **changes):
    fields = {c: None for c in spool.PAYLOAD.names} | {"format_version": 1, "source_event_id": f"e{n}", "event_type": "Stop", "captured_at": n, "session_id": "s", "evidence_kind": "model_claim", "trust": "low", "paths": [], "payload": "é" * n}
    return json.dumps(fields | changes, ensure_ascii=False)


def checksum(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ 0x82F63B78 if c & 1 else c >> 1
    return c ^ 0xFFFFFFFF


def frame(text):
    data = text if isinstance(text, bytes) else text.encode()
    return len(data).to_bytes(4, "little") + checksum(data).to_bytes(4, "little") + data


HEAD = b"LRSP\x01\x00" + bytes(10)


def write(root, session, number, data, head=HEAD, mode="wb"):
    os.makedirs(f"{root}/{session}", exist_ok=True)
    with open(f"{root}/{session}/{number:06}.seg", mode) as f:
        f.write((head if mode == "wb" else b"") + data)


def test_checksums():
    r = random.Random(1)
    data = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 3, 4, 5, 63, 64, 65, 127, 128, 129, 1000, 5000)]
    assert spool.crc32c(data).tolist() == [checksum(d) for d in data]
    assert hex(spool.crc32c([b"123456789"])[0]) == "0xe3069283"


def taken(spark, root, **how):
    rows = spool.accepted(spool.parsed(spool.read_spool(spark, str(root), **how))).collect()
    return sorted((r.session, r.segment, r.offset, r.envelope.source_event_id) for r in rows)


def test_segments_in_ranges_of_any_width(spark, tmp_path):
    places, data = [], b""
    for n in range(40):
        places.append(len(HEAD) + len(data))
        data += frame(envelope(n * 7))
    write(tmp_path, "a", 1, data)
    want = [("a", 1, p, f"e{n * 7}") for n, p in enumerate(places)]
    for width in (100, 999, 1 << 20):
        assert taken(spark, tmp_path, width=width) == want


def test_what_stops_a_session(spark, tmp_path):
    good = [frame(envelope(n)) for n in range(6)]
    write(tmp_path, "sound", 1, good[0] + good[1])
    write(tmp_path, "sound", 2, good[2])
    flipped = bytearray(good[1])
    flipped[-2] ^= 1
    write(tmp_path, "flipped", 1, good[0] + bytes(flipped) + good[2])
    write(tmp_path, "flipped", 2, good[3])
    write(tmp_path, "torn", 1, good[0] + good[1][:-1])
    write(tmp_path, "torn_prefix", 1, good[0] + good[1][:5])
    write(tmp_path, "torn_header", 1, b"", head=HEAD[:7])
    write(tmp_path, "long", 1, good[0] + (1 << 21).to_bytes(4, "little") + good[1][4:])
    write(tmp_path, "magic", 1, good[0])
    write(tmp_path, "magic", 2, good[1], head=b"XXXX" + HEAD[4:])
    write(tmp_path, "magic", 3, good[2])
    write(tmp_path, "newer", 1, good[0], head=b"LRSP\x02\x00" + bytes(10))
    write(tmp_path, "gap", 1, good[0])
    write(tmp_path, "gap", 3, good[2])
    write(tmp_path, "late", 2, good[0])
    write(tmp_path, "bytes", 1, good[0] + frame(b'{"a": "\xff"}') + good[1])
    write(tmp_path, "shape", 1, good[0] + frame("[1]") + good[1])
    write(tmp_path, "extra", 1, frame(envelope(0, more=1)))
    write(tmp_path, "null", 1, frame(envelope(0, trust=None)))
    write(tmp_path, "other", 1, good[0] + frame(envelope(1, format_version=2)))
    write(tmp_path, "empty", 1, b"")
    (tmp_path / "sound" / "notes.txt").write_text("no segment")
    got = {}
    for s, _, _, e in taken(spark, tmp_path):
        got.setdefault(s, []).append(e)
    assert got == {"sound": ["e0", "e1", "e2"], **{s: ["e0"] for s in ("flipped", "torn", "torn_prefix", "long", "magic", "gap", "bytes", "shape", "other")}}
    stops = {r.session: (r.segment, r.status) for r in spool.stalled(spool.parsed(spool.read_spool(spark, str(tmp_path)))).collect()}
    assert stops == {
        "flipped": (1, "bad_checksum"), "long": (1, "oversize"), "magic": (2, "bad_magic"), "newer": (1, "unsupported_version"), "bytes": (1, "not_utf8"), "shape": (1, "malformed"), "extra": (1, "malformed"), "null": (1, "malformed"), "other": (1, "version_mismatch"),
    }
    assert spool.read_spool(spark, str(tmp_path / "nowhere")).count() == 0


def test_writing_and_reading_back(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 3).cast("string").alias("session"), (F.col("id") / 90).cast("int").alias("n"), "id")
    texts = [envelope(i) for i in range(300)]
    lookup = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    frames = rows.join(lookup, "id").select("session", (F.col("n") + 1).alias("segment"), F.col("id").alias("seq"), spool.framed(F.col("text")).alias("frame"))
    spool.write_spool(frames, str(tmp_path))
    got = taken(spark, tmp_path)
    assert sorted(int(e[1:]) for *_, e in got) == list(range(300))
    assert [int(e[1:]) for s, *_, e in got if s == "1"] == list(range(1, 300, 3)), "frames keep their order"
    assert not [f for f in os.listdir(tmp_path) if f.startswith("_")]


def test_stream_resumes_inside_a_segment(spark, tmp_path):
    root, out, state = (str(tmp_path / x) for x in ("spool", "out", "state"))

    def drain():
        run = spool.parsed(spool.stream_spool(spark, root)).filter("status = 'ok'").select("session", "segment", "offset", "envelope.source_event_id")
        run.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.session, r.source_event_id) for r in spark.read.parquet(out).collect())

    first, second, third = (frame(envelope(n)) for n in (1, 2, 3))
    write(root, "a", 1, first + second[:9])
    assert drain() == [("a", "e1")]
    write(root, "a", 1, second[9:] + third, mode="ab")
    write(root, "b", 1, first)
    assert drain() == [("a", "e1"), ("a", "e2"), ("a", "e3"), ("b", "e1")]
    assert drain() == [("a", "e1"), ("a", "e2"), ("a", "e3"), ("b", "e1")]
    write(root, "a", 2, second)
    assert drain()[-2:] == [("a", "e3"), ("b", "e1")] and len(drain()) == 5


# ---- the inverted index

FIELDS = {"name": "name", "body": "body"}


def indexed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, name array<string>, body array<string>")


def ranked(rows, questions, k):
    """BM25 of every document for every question, by plain sums."""
    n, size = len(rows), {i: len(a) + len(b) for i, a, b in rows}
    average = sum(size.values()) / n
    weight = {i: Counter() for i in size}
    for i, a, b in rows:
        for w, tokens in ((4.0, a), (1.0, b)):
            for t in tokens:
                weight[i][t] += w
    df = Counter(t for c in weight.values() for t in c)
    out = []
    for q, tokens in questions:
        terms = set(tokens)
        few = {t for t in terms if df[t] <= n // 2} or set(sorted(terms, key=lambda t: (df[t], t))[:1])
        score = Counter()
        for i, c in weight.items():
            for t in few & set(c):
                score[i] += max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size[i] / average))
        best = sorted(((-round(s, 6), i) for i, s in score.items()))[:k]
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(best)]
    return out


def corpus(seed, ids):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(i, r.choices(words, k=r.randint(0, 3)), r.choices(words, weights=[60 - j for j in range(60)], k=r.randint(0, 40))) for i in ids]


def searched(spark, root, questions, k, **how):
    q = spark.createDataFrame(questions, "query_id long, tokens array<string>")
    return [(r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in index.search(spark, root, q, k, **how).orderBy("query_id", "rank").collect()]


QUESTIONS = [(1, ["w3", "w50", "w51"]), (2, ["w0"]), (3, ["w59", "nowhere"]), (4, []), (5, ["nowhere"]), (6, [f"w{i}" for i in range(0, 60, 3)]), (7, ["w1", "w1", None])]


def asked(questions):
    return [(q, [t for t in tokens if t]) for q, tokens in questions if any(tokens)]


def test_index_ranks_as_plain_sums(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 8)
    rows = corpus(1, [*range(0, 900, 3), 2**40, -5])
    root = f"{tmp_path}/i"
    index.build(indexed(spark, rows), FIELDS, root, shards=3)
    for k in (1, 10, 2000):
        got, want = searched(spark, root, QUESTIONS, k), ranked(rows, asked(QUESTIONS), k)
        assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want, strict=True))
    monkeypatch.setattr(index, "PASS", 5)
    assert searched(spark, root, QUESTIONS, 10) == searched(spark, root, QUESTIONS, 10) == [(q, i, round(s, 6), r) for q, i, s, r in ranked(rows, asked(QUESTIONS), 10)]
    some = indexed(spark, rows).filter("doc_id % 2 = 0").select("doc_id")
    inside = searched(spark, root, [(1, ["w3", "w50"])], 5, within=some)
    every = [x for x in searched(spark, root, [(1, ["w3", "w50"])], 2000) if x[1] % 2 == 0][:5]
    assert [x[1:3] for x in inside] == [x[1:3] for x in every]


def test_merged_index_equals_a_new_one_and_leaves_other_shards(spark, tmp_path):
    old, new = corpus(1, range(400)), corpus(2, [*range(0, 400, 40), 1000, 1001])
    root, again = f"{tmp_path}/i", f"{tmp_path}/j"
    index.build(indexed(spark, old), FIELDS, root, shards=64)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{root}/postings/*/*/*.parquet")}
    index.merge(spark, root, FIELDS, indexed(spark, new), indexed(spark, old).filter("doc_id in (7, 80)").select("doc_id"))
    gone, replaced = {7, 80}, {i for i, _, _ in new}
    now = [x for x in old if x[0] not in gone | replaced] + [x for x in new if x[0] not in gone]
    index.build(indexed(spark, now), FIELDS, again, shards=5)
    want = [(q, i, round(s, 6), r) for q, i, s, r in ranked(now, asked(QUESTIONS), 20)]
    assert searched(spark, root, QUESTIONS, 20) == searched(spark, again, QUESTIONS, 20) == want
    assert {f: os.path.getmtime(f) for f in before} == before
    written = glob.glob(f"{root}/postings/*/shard=*")
    assert 64 < len(written) <= 64 + 13, "only the shards of changed documents are written"
    df = {r.term: r.df for r in index.frequencies(spark, root).collect()}
    assert df == Counter(t for _, a, b in now for t in {*a, *b})
    index.merge(spark, root, FIELDS, gone=indexed(spark, now).select("doc_id").limit(0))
    assert searched(spark, root, QUESTIONS, 20) == want


def test_a_search_leaves_out_postings_and_files(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, ["common"], ["common"] * r.randint(1, 3) + ["rare"] * (i % 500 == 0) + ["filler"] * r.randint(0, 30)) for i in range(4000)]
    group = index.blocks(lexical.postings(indexed(spark, rows), FIELDS), "doc_id", 1).filter("term in ('common', 'rare')").toPandas()
    count = [0, 0]
    found = index._scored(group, {1: [("rare", 6.0), ("common", 1e-6)]}, 5, 20.0, 2e-6, count)
    assert count[0] < 0.1 * count[1] and set(found["id"]) <= set(range(0, 4000, 500))
    root = f"{tmp_path}/i"
    index.build(indexed(spark, rows), FIELDS, root, shards=2)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    df = index.search(spark, root, spark.createDataFrame([(1, ["rare", "other"])], "query_id long, tokens array<string>"), 3)
    pushed = re.findall(r"PushedFilters: \[([^]]*\]?[^]]*)\]", df._jdf.queryExecution().executedPlan().toString())
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert pushed and all("term" in x and "rare" in x for x in pushed), pushed
    # What leaves the tasks that score: at most k rows for a query and shard.
    inside = index._scored(group, {q: [("common", 1.0)] for q in range(7)}, 3, 20.0, 0.0)
    assert len(inside) >= 21 and df.count() == 3


def test_scores_are_not_shuffled(spark):
    docs = indexed(spark, corpus(1, range(300)))
    q = spark.createDataFrame(QUESTIONS, "query_id long, tokens array<string>")
    plan = lexical.lexical_leg(docs, q, FIELDS, 5)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("InMemoryTableScan")]
    assert above.count("Exchange hashpartitioning") == 1 and above.index("Final") < above.index("Exchange hashpartitioning") < above.index("Partial"), "only the best k of each task are dealt by query"
    spark.catalog.clearCache()


# ---- generations


def folder(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_generations_write_what_changed_and_all_stay_readable(spark, tmp_path):
    r, root = random.Random(2), f"{tmp_path}/g"
    tree, trees, looked = {f"p{i}": f"text {i}" for i in range(300)}, {}, []

    def parse(fresh):
        looked.append(sorted(x.revision for x in fresh.collect()))
        return fresh.select("revision", F.length("text").alias("n"))

    def built(t):
        return generations.build(spark.createDataFrame([(p, x, x) for p, x in t.items()], "path string, content_hash string, text string"), root, parse)

    assert generations.head(spark, root) == (0, None)
    for g in range(1, 6):
        trees[g] = dict(tree)
        before = folder(root)
        assert built(tree) == (g, True) and built(tree) == (g, False)
        assert {f: t for f, t in folder(root).items() if f in before} == before, "what earlier generations wrote stays"
        for p in r.sample(sorted(tree), 3):
            tree[p] = r.choice([f"text {r.randrange(300)}", f"new {g}{p}"])
        del tree[r.choice(sorted(tree))]
        tree[f"added{g}"] = "text 1" if g == 2 else f"added {g}"
    seen = set()
    for g, t in trees.items():
        assert {(x.path, x.revision) for x in generations.at(spark, root, g).collect()} == set(t.items())
        assert looked[g - 1] == sorted(set(t.values()) - seen), "only revisions that are new are parsed, each once"
        seen |= set(t.values())
        assert {(x.path, x.n) for x in generations.parsed(spark, root, g, "n int").collect()} == {(p, len(x)) for p, x in t.items()}
        if g > 1:
            assert spark.read.parquet(f"{root}/opened/generation={g}").count() <= 5
    for one, two in ((1, 5), (4, 2), (3, 3)):
        want = {p: (trees[one].get(p), trees[two].get(p)) for p in {*trees[one], *trees[two]} if trees[one].get(p) != trees[two].get(p)}
        assert {x.path: (x.was, x.now) for x in generations.difference(spark, root, one, two).collect()} == want
    target = f"{tmp_path}/t"
    for g in (2, 5, 1, 1, 4):
        generations.switch(spark, root, target, g)
        now, rows, _ = generations.projected(spark, target)
        assert now == g and {(x.path, x.revision) for x in rows.collect()} == set(trees[g].items())


def test_a_build_that_was_cut_off_is_started_again(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/g"
    table = lambda rows: spark.createDataFrame([(p, x, x) for p, x in rows], "path string, content_hash string, text string")
    parse = lambda fresh: fresh.select("revision")
    generations.build(table([("a", "1"), ("b", "2")]), root, parse)

    def failing(fresh):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        generations.build(table([("a", "9"), ("c", "3")]), root, failing)
    assert generations.head(spark, root)[0] == 1 and sorted(x.path for x in generations.at(spark, root, 1).collect()) == ["a", "b"]
    assert generations.members(spark, root).filter("last is null").count() == 2, "what the lost build left is not read"
    assert generations.build(table([("a", "1"), ("c", "3")]), root, parse) == (2, True)
    assert sorted(map(tuple, generations.at(spark, root, 2).collect())) == [("a", "1"), ("c", "3")]
    assert generations.build(table([]), root, parse) == (3, True) and generations.at(spark, root, 3).count() == 0


# ---- deletions


def small_store(spark, root):
    """Generations 0 to 19 with files; revision r has blob r % 7."""
    r = random.Random(9)
    files = [(g, r.randrange(40)) for g in range(20) for _ in range(4)]
    revisions = [(x, x % 7) for x in range(40)]
    tables = {
        "generation": spark.createDataFrame([(g,) for g in range(20)], "generation_id long"), "file": spark.createDataFrame(files, "generation_id long, revision_id long"), "edge": spark.createDataFrame([(g, "e") for g, _ in files], "generation_id long, name string"),
        "occurrence": spark.createDataFrame([(g,) for g, _ in files], "generation_id long"), "skipped": spark.createDataFrame([(3,), (5,)], "generation_id long"), "revision": spark.createDataFrame(revisions, "revision_id long, blob_id long"),
        "unit": spark.createDataFrame(revisions, "revision_id long, blob_id long"), "reference": spark.createDataFrame(revisions[:9], "revision_id long, blob_id long"), "blob": spark.createDataFrame([(b,) for b in range(8)], "blob_id long"),
    }
    keys = dict(retention.PHASES)
    for name, rows in tables.items():
        deletion.store(rows, root, name, keys[name], buckets=16)
    return tables, files, revisions


def test_sweeps_delete_and_leave_other_partitions(spark, tmp_path):
    pins = spark.createDataFrame([(g,) for g in range(20) if g % 4], "generation_id long")
    stays = {g for g in range(20) if g % 4}
    states = []
    for cut in (None, 1, 4, 8):
        root = f"{tmp_path}/{cut}"
        tables, files, revisions = small_store(spark, root)
        before = folder(root)
        if cut is not None:
            assert len(deletion.sweep(spark, root, list(tables), pins, steps=cut)) == cut
            # What is left of the pins doesn't change what was written down.
            assert len(deletion.resume(spark, root)) == 9 - cut
        else:
            steps = deletion.sweep(spark, root, list(tables), pins)
            assert [t for t, _ in steps] == [t for t, _ in retention.PHASES]
            for table, touched in steps:
                same = {f for f, t in folder(f"{root}/{table}").items() if before.get(f) == t}
                assert same == {f for f in before if f.startswith(f"{root}/{table}/") and int(re.search(r"bucket=(\d+)", f)[1]) not in touched}, "untouched partitions keep their files"
        assert not glob.glob(f"{root}/_deletions/*") and deletion.resume(spark, root) == []
        states.append({name: sorted(map(tuple, deletion.read(spark, root, name).collect())) for name in tables})
    live = {x for g, x in files if g in stays}
    blobs = {b for x, b in revisions if x in live}
    want = {
        "generation": sorted((g,) for g in stays), "file": sorted(f for f in files if f[0] in stays), "edge": sorted((g, "e") for g, _ in files if g in stays), "occurrence": sorted((g,) for g, _ in files if g in stays), "skipped": [(3,), (5,)],
        "revision": [x for x in revisions if x[0] in live], "unit": [x for x in revisions if x[0] in live], "reference": [x for x in revisions[:9] if x[0] in live], "blob": sorted((b,) for b in blobs),
    }
    assert states == [want] * 4


def test_a_table_can_lose_all_rows(spark, tmp_path):
    root = str(tmp_path)
    deletion.store(spark.createDataFrame([(k, "x") for k in range(5)], "id long, v string"), root, "t", "id", buckets=3)
    deletion.begin(spark, root, [("t", "id", spark.range(4))])
    assert len(deletion.resume(spark, root)[0][1]) >= 1 and [r.id for r in deletion.read(spark, root, "t").collect()] == [4]
    assert deletion.remove(spark, root, "t", "id", spark.range(100, 110)) == []
    deletion.remove(spark, root, "t", "id", spark.range(10))
    assert deletion.read(spark, root, "t").columns == ["id", "v"] and deletion.read(spark, root, "t").count() == 0
    assert deletion.remove(spark, root, "t", "id", spark.range(10)) == []


# ---- vector shards


def test_shard_lookups_open_few_files(spark, tmp_path):
    root = str(tmp_path)
    points = spark.createDataFrame([(i * 3, [float(i), 1.0]) for i in range(1000)], "vec_id long, embedding array<double>")
    shard.write(points, root, 2, "g", per_file=100)
    ids = spark.createDataFrame([(30,), (33,), (31,), (2997,), (-5,), (10**12,)], "vec_id long")
    assert len(shard.holding(spark, root, ids)) == 2 and 9 <= spark.read.parquet(f"{root}/files").count() <= 11
    assert sorted((r.vec_id, r.embedding[0]) for r in shard.lookup(spark, root, ids).collect()) == [(30, 10.0), (33, 11.0), (2997, 999.0)]
    assert shard.lookup(spark, root, ids.limit(0)).count() == 0
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1.0, 2.0]), (1, [1.0, 2.0])], [(1, None)]):
        with pytest.raises(ValueError, match="dimensions"):
            shard.write(spark.createDataFrame(bad, points.schema), f"{root}/bad", 2, "g")
    shard.write(points.limit(0), f"{root}/empty", 2, "g")
    assert shard.validate(spark, f"{root}/empty", 2, "g") is None and shard.lookup(spark, f"{root}/empty", ids).count() == 0
