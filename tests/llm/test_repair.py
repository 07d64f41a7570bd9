"""Conversation repair, fingerprints and spelling variants against plain walks, on small tables with the awkward cases."""

import collections
import hashlib
import random
import re
import zlib
from functools import lru_cache

from pyspark.sql import functions as F

from tessera.llm import conversations, fingerprints, spelling

D = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---- conversations


def damaged(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        for _ in range({0: 0, 3: 2}.get(how, 1)):
            out[conv].append((turn, "user" if how == 4 else role, text))
        out[conv] += []
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        found = BLANK.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """By trying every edit at every place; a state is what the pattern wants next."""
    forced = {"su": "u", "u": "u", "a": "a", "end": "u"}
    after = {"u": "a", "a": "end"}

    @lru_cache(None)
    def best(i, wants, inserted):
        found = []
        if i == len(rows) and wants in ("su", "end"):
            found.append((0, "", ()))
        if inserted < 3:
            c, audit, lines = best(i, after[forced[wants]], inserted + 1)
            found.append((c + 2, "I" + audit, ((forced[wants], None), *lines)))
        if i < len(rows):
            c, audit, lines = best(i + 1, wants, 0)
            found.append((c + 3, "D" + audit, lines))
            if kinds[i] not in ("blank", "duplicate"):
                charge = kinds[i] == "truncated"
                role = forced[wants]
                c, audit, lines = best(i + 1, after[role], 0)
                found.append((c + 2 + charge, "R" + audit, ((role, i), *lines)))
                own = rows[i][1][:1]
                if own == forced[wants] or own == "s" and wants == "su":
                    c, audit, lines = best(i + 1, "u" if own == "s" else after[own], 0)
                    found.append((c + charge, "K" + audit, ((None, i), *lines)))
        return min(found, key=lambda x: x[:2], default=(10**9, "", ()))

    return best(0, "su", 0)


def repaired(rows):
    kinds = faults(rows)
    cost, audit, lines = cheapest(rows, tuple(kinds))
    names = {"u": "user", "a": "assistant"}
    text = "\n".join(f"{names[r] if r else rows[i][1]}:{'' if i is None else rows[i][2]}" for r, i in lines)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha(text))


COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def same_repair(df, want, conv):
    got = {r[conv]: tuple(r[c] for c in COLUMNS) for r in df.collect()}
    assert got == want


def test_op11_by_trying_all_edits(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: repaired(r) for c, r in damaged(rows).items()}
    assert len({w[6] for w in want.values()}) > 10
    same_repair(conversations.op11(spark, D), want, "conv_id")


AWKWARD = [
    (1, 0, "user", "Hello there."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "No"), (1, 5, "system", "Late."), (None, 0, "user", "No id."), (None, None, None, None), (None, 2, "tool", "x!"), (2, None, "user", "a."),
    (2, None, "user", "a."), (2, 3, "", "nobody."), (3, 0, "assistant", "First!"), (3, 1, "assistant", "Second?"), (3, 2, "assistant", "Third"), (4, 0, "user", " \t\n"), (4, 1, "user", " "), (5, 0, "system", "Only."),
    (6, 0, "user", "ends with space. \n"), (6, 1, "assistant", "x" * 200_000 + "."), (7, -5, "user", "été."), (7, 9, "assistant", "日本。"), (8, 2**60, "user", "far."), (8, 2**60 + 1, "assistant", "farther."),
]


def test_repair_awkward_rows_and_clashing_names(spark, tmp_path):
    extra = {c: F.lit("clash") for c in ("conv", "pos", "fault", "initial", "gone", "audit")}
    df = spark.createDataFrame(AWKWARD, "conv_id long, turn long, role string, text string").withColumns(extra)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    same_repair(conversations.op11(spark, str(tmp_path)), {c: repaired(r) for c, r in damaged(AWKWARD).items()}, "conv_id")


def test_repair_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert conversations.op11(spark, str(tmp_path)).collect() == []


def test_repair_in_pieces_equals_repair_at_once(spark, tmp_path, monkeypatch):
    """Blocks of three rows and pieces joined two at a time: conversations go over many of both."""
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b!", "c", "", "d?"])) for c, n in ((1, 90), (2, 1), (3, 0), (4, 17), (5, 2), (6, 5)) for t in range(n)]
    rows += [(9, t % 4, "user", "again.") for t in range(30)]
    monkeypatch.setattr(conversations, "BLOCK", 3)
    monkeypatch.setattr(conversations, "FAN", 2)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    same_repair(conversations.op11(spark, str(tmp_path)), {c: repaired(x) for c, x in damaged(rows).items()}, "conv_id")


# ---- fingerprints


def winnowed(text, gram=fingerprints.GRAM, window=fingerprints.WINDOW, hashed=hash):
    """(gram, place) that the windows choose, by looking at each window."""
    words = re.findall(r"[^\x20\x09-\x0D]{1,12}", text)
    grams = [tuple(words[i : i + gram]) for i in range(len(words) - gram + 1)] or [tuple(words)] * bool(words)
    h = [hashed(g) for g in grams]
    chosen = {max(range(s, min(s + window, len(h))), key=lambda i: (-h[i], i)) for s in range(max(1, len(h) - window + 1) if h else 0)}
    return [(h[i], i) for i in sorted(chosen)]


TEXTS = [
    "one two three four five six seven eight nine ten eleven twelve", None, "", " \n", "a", "a b c d", "a b c d e", "x " * 40, "日本" * 40, "tick tock " * 30, "One two three four five six seven eight nine ten eleven twelve",
    " ".join(map(str, range(3000))),
]


def hashes_of(spark, grams):
    """Spark's hash of each run of words, one row each."""
    found = spark.createDataFrame([(list(g),) for g in grams], "g array<string>")
    h = F.when(F.size("g") == fingerprints.GRAM, F.xxhash64(*[F.get("g", F.lit(i)) for i in range(fingerprints.GRAM)])).otherwise(F.xxhash64("g"))
    return {tuple(r.g): r.h for r in found.select("g", h.alias("h")).collect()}


def grams_of(texts):
    out = set()
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]{1,12}", t or "")
        out |= {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    return out


def test_op12_by_looking_at_each_window(spark, tmp_path):
    rows = [(i * 10, t) for i, t in enumerate(TEXTS)] + [(None, "no id here at all"), (30, "same id as another")]
    extra = {c: F.lit("clash") for c in ("print", "next", "_key", "_part", "_guest", "edited", "n_chars")}
    spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra).write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprints.op12(spark, str(tmp_path)).collect()
    key = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    order = [(r.doc_id, r.text) for r in sorted(key, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))]
    edits = []
    for k, (_, text) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(text) // 2
        edits.append(text[: len(text) - half] + after[:half])
    h = hashes_of(spark, grams_of([t for _, t in order] + edits))
    prints = [winnowed(t, hashed=h.get) for _, t in order]
    want = []
    for k, ((id, text), e) in enumerate(zip(order, edits, strict=True)):
        mine, theirs, following = prints[k], winnowed(e, hashed=h.get), prints[(k + 1) % len(order)]
        sets = [{x for x, _ in p} for p in (mine, theirs, following)]
        near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        want.append((id, len(text), sha(e), [x for x, _ in mine], [x for x, _ in theirs], *near, [p for _, p in mine], [p for _, p in theirs]))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_shared_runs_share_a_chosen_hash_and_its_place(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 9)))
    run = [word() for _ in range(fingerprints.GRAM + fingerprints.WINDOW - 1)]
    rows = [(k, " ".join([word() for _ in range(r.randint(0, 30))] + run + [word() for _ in range(r.randint(0, 30))])) for k in range(40)]
    found = spark.createDataFrame(rows, "id long, text string").select("id", "text", fingerprints.fingerprint(F.col("text")).alias("f")).collect()
    inside = []
    for x in found:
        at = x.text.split().index(run[0]) if x.text.split().count(run[0]) == 1 else None
        if at is not None:
            inside.append({(f.hash, f.at - at) for f in x.f if at <= f.at <= at + fingerprints.WINDOW - 1})
    assert len(inside) > 30 and len(set.intersection(*inside)) >= 1


def test_ranges_bring_each_document_its_successor(spark):
    r = random.Random(8)
    rows = [(r.randint(-50, 50) or None, f"t{k}") for k in range(300)] + [(7, "same")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.followed(df, "doc_id", "text", {"n": F.length("text")}, per_range=10).collect()
    h = {x.text: x.h for x in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, h[x[1]]))
    want = sorted(((a[0], a[1], len(a[1]), b[1], len(b[1])) for a, b in zip(order, order[1:] + order[:1], strict=True)), key=repr)
    assert sorted(((x.doc_id, x.text, x.n, x.next.text, x.next.n) for x in got), key=repr) == want


def test_op12_on_given_documents(spark):
    got = fingerprints.op12(spark, D).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    ids = sorted(text)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.doc_id)] == ids
    for r in got:
        t, after = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(t) // 2
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(t[: len(t) - half] + after[:half])) and 0 <= r.near_edited <= 1
    long = [r for r in got if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next + 0.1 for r in long) > 0.9 * len(long)


# ---- spelling variants


def variants(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = collections.Counter()
    for id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if id is None else id}:{w}".encode())
            n[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near, keys = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            keys[w[:i], w[i + 1 :]].add(w)
            if (v := w[:i] + w[i + 1 :]) in n:
                near[w].add(v)
                near[v].add(w)
    for g in keys.values():
        for w in g:
            near[w] |= g - {w}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: b if b and n[b] >= 10 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (w, form[w], root(w), k, len(near[w]), n[form[w]] if form[w] else None) for w, k in n.items()}


def same_variants(spark, folder, rows):
    got = {r.word: tuple(r) for r in spelling.op13(spark, folder).collect()}
    want = variants(rows)
    assert got == want
    return want


def test_op13_on_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    assert sum(x[1] is not None for x in same_variants(spark, D, rows).values()) > 5


def test_op13_dense_words(spark, tmp_path):
    """Few letters, so that most words have near ones, runs of equal letters, and counts that make chains of forms."""
    r = random.Random(2)
    words = ["".join(r.choice("aab") for _ in range(r.randint(7, 10))) for _ in range(150)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "éàaaaaa", "éàaaaab", "ÉÀaaaab", "xxxxxxx÷", "a×aaaaaa"]
    rows = [(k, " ".join([w] * r.choice([1, 2, 3, 30, 400]))) for k, w in enumerate(words)]
    rows += [(None, "aaaaaaa bbbbbbb bbbbbbb"), (5, None), (6, ""), (7, "1234567 ......."), (8, "a" * 5000 + " " + "a" * 5000 + " " + "a" * 4999), (8, "a" * 4999), (9, "Zzzzzzz-ZZZZZZZ_zzzzzzz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "run", "prefix", "heavy", "i")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = same_variants(spark, str(tmp_path), rows)
    assert any(x[2] not in (x[0], x[1]) for x in found.values())


def test_op13_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert spelling.op13(spark, str(tmp_path)).collect() == []
