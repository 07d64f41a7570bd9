"""Hand-made cases for the operators whose queries have no SQL or only an easy one."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import chunk, classify, code_units, dense, evaluate, fusion, ledger, redact, retention
from tessera.sources import events, files
from tessera.streaming import observations as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "atom, want",
    [
        ("HTTPServer2Go", ["httpserver2go", "http", "server", "2", "go"]), ("snake_case", ["snake", "case"]), ("kebab-case", ["kebab", "case"]), ("日本語", ["日本語"]),
        ("parseURL", ["parseurl", "parse", "url"]), ("", []), (None, []), ("a", ["a"]),
    ],
)
def test_identifier_splits(spark, atom, want):
    assert fx.split_identifier(atom) == want
    if atom is not None and atom.isascii():
        assert one(spark, fx.identifier_tokens(F.lit(atom))) == want


def test_normalize_is_ordered(spark):
    got = one(spark, fx.normalize(F.lit("\ufeffa \r\nb\t\re\u0301  ")))
    assert got == "a\nb\n\u00e9"


def test_utf8_cut_keeps_characters(spark):
    assert one(spark, fx.utf8_cut(F.lit("日本"), 5)) == "日"
    assert one(spark, fx.utf8_cut(F.lit("abc"), 2)) == "ab"
    assert one(spark, fx.utf8_cut(F.lit(""), 2)) == ""


def test_snippets(spark):
    at = lambda a, b: one(spark, fx.snippet(F.lit("é日x"), F.lit(a), F.lit(b), 3))
    assert at(0, 6).text == "é" and at(0, 6).truncated and at(0, 6).full_bytes == 6
    assert at(1, 3) is None and at(0, 99) is None and at(2, 5).text == "日"


def test_ages_and_prompts(spark):
    age = lambda ms: one(spark, fx.humanized_age(F.lit(ms)))
    assert [age(x) for x in (-5, 0, 5_000, 65_000, 3_700_000, 90_000_000)] == ["just now", "just now", "5s ago", "1m ago", "1h 1m ago", "1d 1h ago"]
    assert one(spark, fx.recall_line(F.lit("a\nb\tc\u0085</memory>"))) == "a bc<\\/memory>"
    rows = spark.createDataFrame([("fact", "active", 0.5, "x\ny", 1)], "kind string, state string, confidence double, text string, rank int")
    assert fx.recall_block(rows, "repo").first().block == "<memory v=1 n=1 scope=repo>\n1. [fact|active|c=0.50|len=3] x y\n</memory>\n"
    assert fx.recall_block(rows.limit(0), "repo").first().block == ""


@pytest.mark.parametrize("text, want", [("see src/a/b.rs, fooBar", "undetermined"), ("\u044d\u0442\u043e \u0440\u0443\u0441\u0441\u043a\u0438\u0439 camelCase snake_case text", "non_latin"), ("```\n\u043a\u043e\u0434 \u043a\u043e\u0434\n```\nplain english words", "english"), (None, "undetermined"), ("na\u00efve caf\u00e9 r\u00e9sum\u00e9", "english"), ("deadbeef-0000-1111-2222 ok", "undetermined")])
def test_exact_scripts(text, want):
    assert fx.script_of(text) == want


def test_scripts(spark):
    cls = lambda t: one(spark, fx.script_class(F.lit(t)))
    assert cls("short") == "undetermined" and cls("plain english words") == "english" and cls("это русский текст here") == "non_latin"
    assert cls("words in english `русский код русский` and more") == "english"


KEY = "-----BEGIN RSA PRIVATE " + "KEY-----"
LONG = "aB3" + "dE5fG6hI7jK8lM9nO0pQ1rS2tU3vW4xY5zA6bC7dE8f"


@pytest.mark.parametrize(
    "text, kinds",
    [
        (KEY, ["private_key"]), (f"x = '{KEY}'", []), ("id AKIA" + "ABCDEFGHIJKLMNOP", ["credential_token"]), ("id AKIA" + "ABC", []),
        ("password = 'hunter2hunter2'", ["assigned_secret"]), ("password = 'short'", []), ("password = 'my-example-1'", []), ("password: 'password'", []),
        ("token = get()", []), (LONG, ["high_entropy"]), (f"https://x.org/{LONG}", []), (f"sha512-{LONG}", []), ("0123456789abcdef" * 3, []), ("", []), (None, []),
    ],
)
def test_redaction_rules(text, kinds):
    assert [k for k, _, _ in redact.scan(text)] == kinds


def test_redaction_merges():
    text = f'token = "{LONG}" and é'
    assert redact.redact_text(text) == ('token = "[REDACTED]" and é', 1)


def test_classification_order(spark):
    lfs = classify.LFS_LINE + "\noid sha256:ab\nsize 12\n"
    cases = [("a.png", lfs.encode(), "lfs"), ("a.png", b"x", "binary"), ("a.txt", b"a\0b", "binary"), ("a.txt", b"\xff\xfe", "encoding"), ("a.py", b"password = 'hunter2hunter2'", "secret"), ("a.py", b"x" * 2000, "huge"), ("a.py", b"x", "indexed"), (".png", b"x", "indexed"), ("a.PNG", b"0", "binary"), ("e", b"", "indexed")]
    df = spark.createDataFrame([(i, p, bytearray(c)) for i, (p, c, _) in enumerate(cases)], "i int, path string, content binary")
    got = {r.i: r.reason for r in classify.classify(df, max_bytes=1000).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_ignore_layers(spark):
    df = spark.createDataFrame([(p,) for p in ("a.log", "x/a.log", "x/keep.log", "build/x.py", "src/build", "x/y/t.tmp")], "path string")
    got = {r.path: r.ignored for r in classify.ignored(df, [("", ["*.log", "build/", "**/*.tmp"]), ("x", ["!keep.log"])]).collect()}
    assert got == {"a.log": True, "x/a.log": True, "x/keep.log": False, "build/x.py": True, "src/build": False, "x/y/t.tmp": True}


def test_chunks():
    text = "intro\n# A\none\n## B\ntwo\n# A\nthree\n"
    got = [(k, q) for _, k, _, q, *_ in chunk.chunks(text, "text")]
    assert got == [("file", None), ("text_section", None), ("text_section", "A"), ("text_section", "A/B"), ("text_section", "A#2")]
    assert [(a, b) for *_, a, b, _, _ in chunk.chunks("x" * 3000, "fallback")[1:]] == [(0, 3000)]
    parts = chunk.chunks("\n".join(["y" * 1000] * 5), "fallback")[1:]
    assert all(c[5] - c[4] <= 2048 for c in parts) and parts[-1][5] == 5004 and len(chunk.chunks("", "text")) == 1
    assert [c[2] for c in chunk.chunks("; c\n\"a\": 1\n  b: 2\na = 3\n", "config")[1:]] == [None, "a", "a"]


def test_python_units_and_broken_source():
    units, refs, ok = code_units.parse("import a.b\nclass C:\n  def m(self): pass\n@d\ndef f(): pass\nx = 1\n", "python")
    assert ok and [(k, n, p) for _, k, n, _, _, p in units] == [("file", None, None), ("class", "C", 0), ("method", "m", 1), ("function", "f", 0), ("variable", "x", 0)]
    assert refs == [("a.b", "import")] and code_units.parse("def (", "python")[2] is False


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query_vector array<float>")
    got = [(r.vec_id, r.score) for r in dense.nearest(df, q, 3).orderBy("rank").collect()]
    assert got == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert dense.nearest(df.limit(0), q, 3).count() == 0 and dense.nearest(df, q.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="dimension"):
        dense.nearest(spark.createDataFrame([(1, [1.0])], df.schema), q, 1).collect()


def test_vector_codec(spark):
    df = spark.createDataFrame([(1, [1.0, 2.5])], "i int, v array<float>").select(dense.encode_le("v").alias("blob"), F.lit(2).alias("dimensions"))
    assert df.select(dense.decode_le("blob").alias("v")).first().v == [1.0, 2.5]
    bad = df.withColumn("checksum", F.lit("x"))
    assert dense.verified(bad).first().divergence == "checksum" and dense.verified(bad.withColumn("dimensions", F.lit(3))).first().divergence == "length"


def test_embedder_and_remotes(spark):
    v = dense.embed_text("Alpha beta_1")
    assert abs(float((v * v).sum()) - 1) < 1e-6 and (v != 0).sum() <= 3 and (dense.embed_text("!?") != 0).sum() == 1 and (dense.embed_text(None) == 1).sum() == 1
    remote = lambda u: one(spark, fx.remote_url(F.lit(u)))
    assert remote("https://u:p@Git.Example.org:8443/Team/Repo.git/") == "git.example.org/Team/Repo" and remote("git@Host:Team/x.git") == "host/Team/x"
    assert remote("host/path/") == "host/path" and remote(" ssh://h ") == "h" and remote("h/a:b") == "h/a:b"


def test_rrf_by_hand(spark):
    leg = lambda ids: spark.createDataFrame([(0, i, n + 1) for n, i in enumerate(ids)], "query_id int, doc_id int, rank int")
    got = fusion.rrf(leg([1, 2]), leg([2, 3]), weights=(1.0, 1.0)).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 1, 3] and abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-8
    with pytest.raises(RuntimeError):
        fusion.search(None, None, 5)
    with pytest.raises(ValueError):
        fusion.search(leg([1]), None, 5, "semantic")


def test_recall_stops_at_the_first_overflow(spark):
    c = spark.createDataFrame([(1, "a" * 40, 3), (2, "b" * 400, 2), (3, "c", 1)], "entry_id long, text string, created_at long")
    none = spark.createDataFrame([], "entry_id long, rank int")
    assert [r.entry_id for r in fusion.recall(c, none, none, 60, fx.token_estimate(F.col("text"))).collect()] == [1]


def test_windowed_dedup(spark):
    rows = [(1, n, n * 1000, f"e{n}") for n in range(600)] + [(1, 600, 2_000_000, "e0"), (1, 601, 2_000_001, "e599"), (1, 602, 2_000_002, None), (1, 603, 2_000_003, None), (2, 604, 0, "e0")]
    df = spark.createDataFrame(rows, "session_id long, received_seq long, at_ms long, source_event_id string")
    kept = {r.received_seq for r in stream.windowed_dedup(df).collect()}
    assert 600 in kept and 601 not in kept and {602, 603, 604} <= kept and len(kept) == 604
    assert stream.windowed_dedup(df.limit(0)).count() == 0


def test_streaming_dedup_equals_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(f"k{i % 7}", i, at) for i in range(50)], "dedup_key string, received_seq long, ts timestamp")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.stream_exact_dedup(live).writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.dedup_key for r in spark.table("deduped").collect()} == {r.dedup_key for r in stream.exact_dedup(df).collect()} and spark.table("deduped").count() == 7


def test_import_writes_once(spark, tmp_path):
    df = spark.createDataFrame([(i % 9, i) for i in range(18)], "event_id long, v long")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        stream.import_once(live, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


def test_spool_and_hooks(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": ')
    from pyspark.sql import types as T

    good, bad = events.read_spool(spark, str(tmp_path / "s.jsonl"), T.StructType([T.StructField("a", T.IntegerType())]))
    assert good.count() == 2 and bad.count() == 1
    raw = [json.dumps({"session_id": "s", "hook_event_name": "Stop"}), json.dumps({"hook_event_name": "Stop"}), json.dumps({"session_id": "s", "hook_event_name": "No"}), "junk"]
    ok, rejected = events.parse_hook(spark.createDataFrame([(r,) for r in raw], "value string"))
    assert ok.count() == 1 and sorted(r.reason for r in rejected.collect()) == ["no json object", "no session_id", "unknown event"]


def test_scan_and_snapshots(spark, tmp_path):
    root = tmp_path / "tree"
    for p, t in {"a.py": "x", "b/c.md": "yy", ".git/x": "z", "b/skip.tmp": "t"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    manifest = files.scan(spark, str(root), max_bytes=1, rules=[("", ["*.tmp"])])
    assert [(r.path, r.content_hash is None) for r in manifest.collect()] == [("a.py", False), ("b/c.md", True)]
    assert [r.path for r in files.scan_paths(spark, str(root)).collect()] == ["a.py", "b/c.md", "b/skip.tmp"]
    again = files.rescan(spark, str(root), manifest, max_bytes=1, rules=[("", ["*.tmp"])])
    assert [(r.path, r.reused) for r in again.collect()] == [("a.py", True), ("b/c.md", False)]
    assert files.rescan(spark, str(root), manifest, strict=True).filter("reused").count() == 0
    (root / "a.py").write_text("other")
    (root / ".gitignore").write_text("*.tmp\n")
    (root / "b" / ".ignore").write_text("!skip.tmp\n*.md\n")
    rules = files.ignore_rules(spark, str(root))
    assert rules == [("", ["*.tmp", ""]), ("b", ["!skip.tmp", "*.md", ""])]
    seen = files.rescan(spark, str(root), manifest, rules=rules)
    assert {r.path: (r.reused, r.content_hash) for r in seen.collect()} == {r.path: (False, r.content_hash) for r in files.scan(spark, str(root), rules=rules).collect()} and "b/skip.tmp" in {r.path for r in seen.collect()}
    changed, seen = files.reconcile(manifest, None)
    assert changed and files.reconcile(manifest, seen) == (False, seen)
    out = str(tmp_path / "pub")
    files.publish(manifest, out, "m")
    files.publish(manifest.limit(1), out, "m")
    assert files.current(spark, out, "m").count() == 1
    points = spark.createDataFrame([(i, [0.5, float(i)]) for i in range(10)], "vec_id long, embedding array<float>")
    files.write_shard(points, str(tmp_path / "shard"), partitions=2)
    assert sorted(r.vec_id for r in files.read_shard(spark, str(tmp_path / "shard"), 10, 2).collect()) == list(range(10))
    for count, dims in ((9, 2), (10, 3)):
        with pytest.raises(ValueError):
            files.read_shard(spark, str(tmp_path / "shard"), count, dims)


def test_eviction_walks_the_oldest_and_spares_pins(spark):
    c = spark.createDataFrame([(i, 10, i // 2) for i in range(10)], "key long, bytes long, last_used long")
    pins = c.filter("key = 0").select("key")
    assert sorted(r.key for r in retention.evict(c, 75, pins).collect()) == [1, 2, 3]
    assert retention.evict(c, 1000).count() == 0 and retention.evict(c.limit(0), 10).count() == 0


def test_due_and_gates(spark):
    e = spark.createDataFrame([(1, 1, 0, "x"), (2, 2, 0, "Stop"), (3, 3, 10**9, "x")], "session_id long, received_seq long, at_ms long, event_type string")
    cur = spark.createDataFrame([(3, 9)], "session_id long, last_seq long")
    got = {r.session_id: r.reason for r in ledger.due(e, cur, 90_000_000).collect()}
    assert got == {1: "idle", 2: "stop"}
    assert evaluate.gate(0.70, 0.73, 0.03) and not evaluate.gate(0.6998, 0.73, 0.03)


def test_routing_metrics(spark):
    df = lambda r: spark.createDataFrame(r, "case_id int, kind string")
    got = evaluate.routing(df([(1, "a"), (1, "a"), (2, "b")]), df([(1, "a"), (2, "b"), (2, "c")])).first()
    assert (got.precision, got.recall, got.f1, got.exact_match) == (0.666667, 0.666667, 0.666667, 0.0)


def test_locator(spark):
    m = lambda k: F.create_map(F.lit(k), F.lit("v"), F.lit("a"), F.lit("1"))
    assert one(spark, chunk.locator(m("k"))) == "a=1;k=v;" and one(spark, chunk.locator(m("x/y"))) is None
    assert one(spark, chunk.parse_locator(F.lit("a=1;k=v;"))) == {"a": "1", "k": "v"}


def test_whole_table_queries_keep_every_row(spark):
    """Secrets, long turns, closing tags and control characters are in the results, not filtered out before."""
    from tessera.plans import catalog

    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r.reason for r in catalog.QUERIES["p1_p4_classify"](spark, d).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert set(got) == set(texts) and "secret" in got.values()
    assert {i for i, t in texts.items() if len((t or "").encode()) > 12000} == {i for i, r in got.items() if r == "huge"}
    key = re.compile(r"(?<![A-Za-z0-9_-])(AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9_-])")
    assert all(got[i] in ("secret", "huge") for i, t in texts.items() if key.search(t or ""))

    def line(t):
        t = re.sub(r"[\x00-\x1f\x7f-\x9f]", "", t.replace("\n", " ")).replace("</memory", "<\\/memory")
        return t.encode()[:1024].decode(errors="ignore")

    lines = sorted((r.conv_id, r.turn, r.line) for r in catalog.QUERIES["r23_recall_line"](spark, d).collect())
    turns = spark.read.parquet(f"{d}/conversations.parquet").collect()
    assert lines == sorted((r.conv_id, r.turn, line(r.text)) for r in turns) and any(len(r.text.encode()) > 1024 for r in turns)


def test_long_runs_are_scanned_once():
    """A line of a million characters of one kind, where a careless pattern takes minutes."""
    import time

    from tessera.operators.redact import redact_text

    for text in ("a" * 1_000_000, "a." * 500_000, "-----BEGIN " * 90_000, "://" * 300_000):
        began = time.time()
        redact_text(text)
        assert time.time() - began < 20
    keys = "".join(f"key{i} = {i}\n" for i in range(20_000))
    began = time.time()
    units, _, _ = code_units.parse(keys, "toml")
    assert len(units) == 20_001 and all(u[5] == 0 for u in units[1:]) and time.time() - began < 30


def test_parents_equal_brute_force(spark):
    import random

    r = random.Random(4)
    spans = [(p, i, a := r.randint(0, 30), a + r.randint(0, 12)) for p in ("x", "y") for i in range(60)]
    got = {(u.path, u["index"]): u.parent for u in chunk.parents(spark.createDataFrame(spans, "path string, index long, start long, end long")).collect()}
    for p, i, a, b in spans:
        around = [(y - x, -j) for q, j, x, y in spans if q == p and x <= a and b <= y and (x, y) != (a, b)]
        assert got[p, i] == (-min(around)[1] if around else None)


def test_scan_manifest_hashes_the_files(spark):
    import hashlib
    import os

    from tessera.plans import catalog

    d = "/root/testdata/sf0.001"
    want = {n: hashlib.sha256(open(f"{d}/{n}", "rb").read()).hexdigest() for n in os.listdir(d) if os.path.isfile(f"{d}/{n}")}
    got = catalog.QUERIES["s1_s4_scan_manifest"](spark, d).collect()
    assert {r.path: r.content_hash for r in got} == want and {r.reused for r in got} == {True, False}
    listed = {r.path for r in catalog.QUERIES["s2_s3_scan_paths"](spark, d).collect()}
    assert listed == {n for n in want if not n.endswith("n.parquet")} | {"region.parquet"}


def test_purges(spark):
    m = spark.createDataFrame([(1,), (2,), (3,)], "entry_id long")
    ev = spark.createDataFrame([(1, 10), (2, 10), (2, 20), (3, 20)], "entry_id long, event_id long")
    env = spark.createDataFrame([("a", 10), ("b", 20), (None, 30)], "session_id string, event_id long")
    kept, proof, left = ledger.purge_session(m, ev, env, "a")
    assert sorted(r.entry_id for r in kept.collect()) == [2, 3] and proof.count() == 2 and left.count() == 2
    seen = {r.name: (r.rows, r.gone) for r in ledger.purge_preview({"m": m, "ev": ev}, {"m": kept, "ev": proof}).collect()}
    assert seen == {"m": (3, 1), "ev": (4, 2)} and ledger.purge_preview({"m": m}).first().gone == 3


def test_nearest_equals_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(5)
    v = r.integers(-2, 3, (300, 4)).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(400, None)], "vec_id long, embedding array<float>").repartition(5)
    asked = df.filter("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query_vector")
    for metric in ("dot", "cosine", "l2"):
        got = {}
        for x in dense.nearest(df, asked, 7, metric, chunk=64).orderBy("rank").collect():
            got.setdefault(x.query_id, []).append((x.vec_id, x.score))
        for i in range(0, 300, 20):
            norm = np.linalg.norm(v, axis=1) * np.linalg.norm(v[i])
            s = v @ v[i] if metric == "dot" else -np.linalg.norm(v - v[i], axis=1) if metric == "l2" else np.divide(v @ v[i], norm, out=np.zeros(300), where=norm > 0)
            s = np.round(s, 6) + 0.0
            assert got[i] == [(int(j), s[j]) for j in np.lexsort((np.arange(300), -s))[:7]]
    assert dense.nearest(df, asked.limit(0), 7).count() == 0
    with pytest.raises(Exception, match="dimension"):
        dense.nearest(df, asked.withColumn("query_vector", F.slice("query_vector", 1, 3)), 7).count()


def test_embedding_equals_the_rule_by_hand():
    import numpy as np

    full = (1 << 64) - 1

    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 & full
        return h

    texts = ["Alpha beta_1 alpha", "", None, "!?", "caf\u00e9 " + "x" * 300, "one"]
    for text, got in zip(texts, dense.embed_texts(texts)):
        words, want = [fnv(w.encode()) for w in re.findall(r"\w+", (text or "").lower())], np.zeros(dense.DIMS)
        pairs = [(((a ^ 0x9E3779B97F4A7C15) * 0x100000001B3 & full) ^ ((b << 31 | b >> 33) & full)) * 0x100000001B3 & full for a, b in zip(words, words[1:])]
        for h in words + pairs:
            want[h % dense.DIMS] += -1 if h >> 63 else 1
        if not words:
            want[fnv((text or "").encode()) % dense.DIMS] = 1
        assert np.allclose(got, want / np.linalg.norm(want))


def test_sweepable_keeps_what_is_named(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "generation": df([(1,), (2,)], "generation_id int"), "file": df([(1, 10), (2, 20), (2, 10)], "generation_id int, revision_id int"),
        "revision": df([(10, 100), (20, 200), (30, 100)], "revision_id int, blob_id int"), "blob": df([(100,), (200,), (300,)], "blob_id int"),
    }
    gone = {name: sorted(tuple(r) for r in rows.collect()) for name, rows in retention.sweepable(tables, tables["generation"].filter("generation_id = 1")).items()}
    assert gone == {"file": [(2, 10), (2, 20)], "generation": [(2,)], "revision": [(20, 200), (30, 100)], "blob": [(200,), (300,)]} and list(gone) == ["file", "generation", "revision", "blob"]
    plan = retention.sweep_plan(tables, tables["generation"].filter("generation_id = 1"), batch_rows=1).collect()
    assert {(r.phase, r.rows, r.batches) for r in plan} == {("file", 2, 2), ("generation", 1, 1), ("revision", 2, 2), ("blob", 2, 2)}


def test_range_counts_equal_brute_force(spark):
    import random

    from tessera.operators.stats import range_counts

    r = random.Random(6)
    points = [(r.choice("ab"), r.randint(0, 30)) for _ in range(80)]
    ranges = [(i, r.choice("abc"), a := r.randint(-2, 30), a + r.randint(-3, 9)) for i in range(60)]
    got = {x.id: x.n for x in range_counts(spark.createDataFrame(ranges, "id int, k string, lo int, hi int"), spark.createDataFrame(points, "k string, at int"), "k", "lo", "hi", "at", "id").collect()}
    assert got == {i: sum(k == p and a <= x <= b for p, x in points) for i, k, a, b in ranges}


def test_codec_and_backfill_queries(spark):
    """Queries that SQL cannot express, against the same computed by hand."""
    import hashlib
    import struct
    import unicodedata

    from tessera.plans import catalog

    d = "/root/testdata/sf0.001"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    blobs = {i: b"".join(struct.pack("<f", x) for x in v) for i, v in vectors.items()}
    got = {r.vec_id: (r.checksum, r.divergence is not None, r.decoded) for r in catalog.QUERIES["s11_vector_codec"](spark, d).collect()}
    assert got == {i: ("bad" if i % 10 == 0 else sha(b), i % 10 == 0, len(vectors[i])) for i, b in blobs.items()}

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    valid = {sha(t.encode()) for i, t in texts.items() if i % 3 == 0 and i % 9 != 0}
    todo = {sha(t.encode()): t for t in texts.values() if sha(t.encode()) not in valid}
    got = {r.subject_hash: r.vector_sha256 for r in catalog.QUERIES["r24_r25_backfill"](spark, d).collect()}
    assert got == {h: sha(dense.embed_text(t).astype("<f4").tobytes()) for h, t in todo.items()}

    def normal(t):
        t = unicodedata.normalize("NFC", t.lstrip("\ufeff") if t.startswith("\ufeff") else t).replace("\r\n", "\n").replace("\r", "\n")
        return "\n".join(line.rstrip() for line in t.split("\n"))

    assert {r.doc_id: r.normalized_sha256 for r in catalog.QUERIES["f1_normalize_unicode"](spark, d).collect()} == {i: sha(normal(t).encode()) for i, t in texts.items()}


def test_chunk_query_covers_every_file(spark):
    from tessera.plans import catalog

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = {}
    for r in catalog.QUERIES["c1_c6_universal_chunks"](spark, d).collect():
        rows.setdefault(int(re.search(r"/d(\d+)\.", r.path)[1]), []).append(r)
    assert set(rows) == set(docs)
    for i, found in rows.items():
        data = (f"# A\n{docs[i]}\n## B\nend" if i % 5 == 0 else docs[i]).encode()
        found.sort(key=lambda r: r.ordinal)
        assert [r.ordinal for r in found] == list(range(len(found))) and (found[0].kind, found[0].start, found[0].end, found[0].parent) == ("file", 0, len(data), None)
        at = 0
        for r in found[1:]:
            assert r.parent == 0 and r.start >= at and not data[at : r.start].strip() and data[r.start : r.end].strip()
            assert r.end - r.start <= chunk.MAX_CHUNK or data[r.start : r.end].rstrip(b"\n").count(b"\n") == 0
            at = r.end
        assert not data[at:].strip()
        if i % 5 == 0 and found[0].path.endswith(".md"):
            assert found[1].name == "A" and found[-1].name == "B"


@pytest.mark.parametrize(
    "language, text, want",
    [
        ("javascript", "// class No {\nconst s = 'function no() {';\nfunction f() {\n  return `}` + \"}\"; /* } */\n}\nclass A {\n  m(x) {\n  }\n}\n", [("function", "f", 5), ("class", "A", 9), ("method", "m", 8)]),
        ("rust", "/* fn no() { */\nfn f<'a>(x: &'a str) -> char {\n    let s = r#\"}\"#; '}'\n}\nstruct S { a: u8 }\n", [("function", "f", 4), ("struct", "S", 5)]),
        ("go", "package p\nvar x = `func no() {`\nfunc f() {\n\ts := \"}\" // }\n}\n", [("variable", "x", 2), ("function", "f", 5)]),
        ("bash", "# no() {\nf() {\n  echo '}' \"}\" # }\n}\n", [("function", "f", 4)]),
        ("toml", "a = \"\"\"\nno = 1\n\"\"\"\n# b = 2\n[t]\nk = 1\n", [("key", "a", 1), ("table", "t", 6), ("key", "k", 6)]),
    ],
)
def test_units_outside_strings_and_comments(language, text, want):
    found = [(kind, name, text.encode()[:end].count(b"\n") + (not text.encode()[:end].endswith(b"\n"))) for _, kind, name, _, end, _ in code_units.parse(text, language)[0][1:]]
    assert sorted(found) == sorted(want)


def test_imports_outside_comments():
    text = "// import a from 'no';\nimport b from 'yes';\nconst s = `\nimport c from 'no';\n`;\n"
    assert [r for r, _ in code_units.parse(text, "javascript")[1]] == ["yes"]
    units, _, _ = code_units.parse("fn é() {}\nfn b() {}\n", "rust")
    assert [u[3:5] for u in units[1:]][-1] == (11, 20) or units[-1][2] == "b"


# ---- what a search, a scan and a create once got wrong


def test_distances_far_from_the_origin(spark):
    points = [(i, [1000.0 + i * 0.0008, 1000.0, -1000.0]) for i in range(60)]
    p = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1000.0, 1000.0, -1000.0]), (2, [1000.0238, 1000.0, -1000.0])], "query_id long, query_vector array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in dense.nearest(p, q, 4, "l2", chunk=7).collect()}
    for query, at in ((1, 1000.0), (2, 1000.0238)):
        want = sorted((round(abs(v[0] - at), 6), i) for i, v in points)[:4]
        assert [got[query, k + 1] for k in range(4)] == [(i, -d + 0.0) for d, i in want]


@pytest.mark.parametrize("broadcast", [True, False])
def test_neighbours_of_some_kinds(spark, monkeypatch, broadcast):
    import random

    if not broadcast:
        monkeypatch.setattr(dense, "BROADCAST_BYTES", 0)
    r = random.Random(3)
    points = [(i, [r.gauss(0, 1) for _ in range(5)], "rare" if i % 1000 == 7 else "tenth" if i % 10 == 1 else None if i % 11 == 0 else "common") for i in range(3000)]
    asked = [(1, ["rare"]), (2, ["tenth"]), (3, None), (4, ["rare", "tenth"]), (5, []), (6, ["nothing"]), (7, ["common", "None"])]
    queries = [(i, [r.gauss(0, 1) for _ in range(5)], kinds) for i, kinds in asked]
    for metric in ("cosine", "l2"):
        got = dense.nearest(
            spark.createDataFrame(points, "vec_id long, embedding array<double>, kind string"), spark.createDataFrame(queries, "query_id long, query_vector array<double>, kinds array<string>"), 8, metric, chunk=500, kind="kind", kinds="kinds"
        ).collect()
        for i, v, kinds in queries:
            near = lambda x, v=v: sum(a * b for a, b in zip(x, v)) / (sum(a * a for a in x) * sum(b * b for b in v)) ** 0.5 if metric == "cosine" else -(sum((a - b) ** 2 for a, b in zip(x, v)) ** 0.5)
            want = sorted((-round(near(x), 6), p) for p, x, kind in points if kinds is None or kind in kinds)[:8]
            assert [(x.vec_id, x.score) for x in sorted((g for g in got if g.query_id == i), key=lambda g: g["rank"])] == [(p, -s) for s, p in want]


def test_scans_below_folders_of_the_same_name(spark, tmp_path):
    root = tmp_path / "src.d"
    for name in ("b.py", "a/src.d/b.py", "a/srcxd/b.py", "src.d/src.d/c.py", "é/ä b.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    want = sorted(["b.py", "a/src.d/b.py", "a/srcxd/b.py", "src.d/src.d/c.py", "é/ä b.py"])
    for given in (str(root), f"{root}/", f"file://{root}"):
        assert [r.path for r in files.scan_paths(spark, given).collect()] == want
        assert len({r.content_hash for r in files.scan(spark, given).collect()}) == 5
    before = files.scan(spark, str(root))
    before = spark.createDataFrame([tuple(r) for r in before.collect()], before.schema)
    (root / "a/src.d/b.py").write_text("changed")
    after = {r.path: r.reused for r in files.rescan(spark, str(root), before).collect()}
    assert after == {p: p != "a/src.d/b.py" for p in want}


def test_creates_with_one_canonical_key(spark):
    schema = "entry_id long, kind string, scope_kind string, scope_owner long, canonical_key string, state string, idempotency_key string, evidence_kind string"
    old = spark.createDataFrame([(1, "fact", "repo", 1, "taken", "active", None, "tool_result")], schema)
    new = [(10, "k"), (11, "k"), (12, None), (13, None), (14, "taken"), (15, "other")]
    rows = spark.createDataFrame([(i, "fact", "repo", 1, key, None, None, "user_statement") for i, key in new] + [(16, "fact", "repo", 2, "k", None, None, "user_statement")], schema).drop("state")
    assert sorted(r.entry_id for r in ledger.create(old, rows, F.lit(0)).collect()) == [10, 12, 13, 15, 16]


def test_places_over_ranges(spark):
    import random

    r = random.Random(1)
    rows = [(i, r.choice([0.0, 0.5, r.random()])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, score double").repartition(7)
    got = {x.id: x["rank"] for x in fusion.placed(df, F.desc("score"), F.asc("id")).collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    assert fusion.placed(df.limit(0), F.asc("id")).count() == 0


def test_recall_passes_over_what_has_changed(spark):
    c = spark.createDataFrame([(i, f"text {i}", i) for i in range(6)], "entry_id long, text string, created_at long")
    legs = spark.createDataFrame([(i, i + 1) for i in range(6)], "entry_id long, rank long")
    now = spark.createDataFrame([(0, "active", "a" * 40), (1, "retracted", "text 1"), (2, "active", "text 2"), (4, "superseded", "x"), (5, "confirmed", "text 5")], "entry_id long, state string, text string")
    got = fusion.recall(c, legs, legs, 100, fx.token_estimate(F.col("text")), fresh=now).orderBy("rank").collect()
    assert [(x.entry_id, x.text) for x in got] == [(0, "a" * 40), (2, "text 2"), (5, "text 5")] and got[0].cost == 18


def test_evict_rows_of_one_time(spark):
    rows = [(i, 10, 5 if i % 2 else i) for i in range(500)]
    cache = spark.createDataFrame(rows, "key long, bytes long, last_used long")
    pins = spark.createDataFrame([(1,), (2,)], "key long")
    walk, gone, freed = sorted((r for r in rows if r[0] not in (1, 2)), key=lambda r: (r[2], r[0])), set(), 0
    for key, size, _ in walk:
        if freed >= 5000 - 1234:
            break
        gone.add(key)
        freed += size
    assert {r.key for r in retention.evict(cache, 1234, pins).collect()} == gone
    assert retention.evict(cache, 5000).count() == 0 and retention.evict(cache.limit(0), 0).count() == 0


def test_overviews_are_kept_by_manifest(spark, tmp_path):
    from tessera.operators import stats

    files_ = spark.createDataFrame([("a/b/main.py", "1"), ("a/c.ts", "2"), ("bin/x", "3")], "path string, content_hash string")
    refs = spark.createDataFrame([("m",), ("m",), ("n",)], "reference string")
    look = lambda f, r: sorted(map(tuple, stats.cached_overview(f, r, str(tmp_path)).collect()), key=repr)
    first = look(files_, refs)
    assert ("entry_point", None, "bin/x", 1) in first and ("reference", None, "m", 2) in first and ("tree", 1, "a", 2) in first and ("tree", 0, "", 3) in first
    assert look(files_, refs.limit(0)) == first, "the same files are not looked at again"
    assert look(files_.filter("path <> 'bin/x'"), refs.limit(0)) != first


def test_words_of_any_script_are_split_whole(spark):
    from tessera.plans import catalog

    d = "/root/testdata/sf0.001"
    got = {r.word: r.tokens for r in catalog.QUERIES["r1_identifier_tokens_any_script"](spark, d).collect()}
    words = {w for r in spark.read.parquet(f"{d}/documents.parquet").collect() for w in re.split(r"[ \t\n\x0b\f\r]+", r.text or "") if w}
    assert set(got) == words and all(got[w] == fx.split_identifier(w) for w in words)


def test_scans_see_hidden_files_and_leave_other_trees_out(spark, tmp_path):
    root = tmp_path / "tree"
    seen = [".env", "a/.hidden", "a/_under/x.py", ".github/workflows/ci.yml", ".github/.deep/y", "b/c/d.py", "_build/z", "kept.log"]
    unseen = [".git/config", "a/sub/.git/HEAD", "a/sub/x.py", "a/sub/deep/y.py", "linked/.git", "linked/z.py", "no.tmp", "a/no.log"]
    for name in seen + unseen:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (root / ".git/info").mkdir()
    (root / ".git/info/exclude").write_text("*.tmp\n*.log\n")
    (root / ".gitignore").write_text("!kept.log\n")
    rules = files.ignore_rules(spark, str(root))
    assert [r.path for r in files.scan_paths(spark, str(root), rules=rules).collect()] == sorted([*seen, ".gitignore"])
    assert {r.path for r in files.scan_paths(spark, str(root)).collect()} == {*seen, ".gitignore", "no.tmp", "a/no.log"}
    before = files.scan(spark, str(root))
    before = spark.createDataFrame([tuple(r) for r in before.collect()], before.schema)
    (root / ".env").write_text("changed")
    assert [r.path for r in files.rescan(spark, str(root), before).filter("not reused").collect()] == [".env"]
