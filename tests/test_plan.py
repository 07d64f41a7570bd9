"""Plans of operations against a store that applies one after the other to everything."""

import random

from tessera.operators import plan
from tessera.operators.ledger import TERMINAL, TRANSITIONS

ENDS = {"resolve": "resolved", "retract": "retracted", "confirm": "confirmed", "reject": "rejected"}
E_NAMES = [c.split()[0] for c in plan.ENTRY.split(", ")]
OP_NAMES = [c.split()[0] for c in plan.OP.split(", ")]


def one_by_one(entries, evidence, audits, ops):
    """All operations over whole tables; each is looked at afresh, and what fails changes nothing."""
    store = {e["entry_id"]: dict(e) for e in entries}
    cited = {(e, v): k for e, v, k in evidence}
    log = list(audits)
    results, stale = [], set()

    def legal(e, to):
        return e["state"] == to or f"{e['state']}>{to}" in TRANSITIONS.get(e["kind"], "").split()

    for op in sorted(ops, key=lambda o: o["index"]):
        name, key, id = op["op"], op["idempotency_key"], op["entry_id"]
        before = next(((e, v) for e, v, _, k in log if k is not None and k == key), None)
        if name == "noop":
            results.append((op["index"], "noop", None, None))
            continue
        if before:
            results.append((op["index"], "replayed", *before))
            continue
        e, wrong, answer = store.get(id), None, id
        evidence_of = op["evidence"] or []
        if name not in ("create", "noop", "nonsense"):
            if name == "merge" and not op["losers"]:
                wrong = "empty_merge"
            elif e is None:
                wrong = "unknown_entry"
            elif e["entry_version"] != op["expected_version"]:
                wrong = "version_conflict"
        if wrong:
            pass
        elif name in ENDS and not legal(e, ENDS[name]) or name == "supersede" and not legal(e, "superseded"):
            wrong = "illegal_transition"
        elif name == "edit" and e["state"] in TERMINAL:
            wrong = "entry_terminal"
        elif name in ("create", "supersede"):
            answer = id if name == "create" else op["new_id"]
            scope = (op["scope_kind"], op["scope_owner"], op["canonical_key"])
            if op["actor"] == "router" and op["kind"] in plan.PROMOTED and evidence_of and {k for _, k in evidence_of} == {"model_claim"}:
                wrong = "model_claim_only"
            elif scope[2] is not None and any((x["scope_kind"], x["scope_owner"], x["canonical_key"]) == scope for x in store.values()):
                wrong = "canonical_key_conflict"
            elif answer is None or answer in store:
                wrong = "entry_exists"
        elif name == "merge":
            for loser, version in op["losers"]:
                x = store.get(loser)
                wrong = wrong or ("unknown_entry" if x is None else "version_conflict" if x["entry_version"] != version else "incompatible_scope" if (x["scope_kind"], x["scope_owner"]) != (e["scope_kind"], e["scope_owner"]) else None if legal(x, "superseded") else "illegal_transition")
        elif name == "nonsense":
            wrong = "unknown_op"
        if wrong:
            results.append((op["index"], wrong, None, None))
            continue
        if name in ("create", "supersede"):
            fields = {c: op[c] for c in ("kind", "scope_kind", "scope_owner", "canonical_key", "text", "confidence", "importance")}
            store[answer] = {**fields, "entry_id": answer, "state": "active", "entry_version": 1, "supersedes_id": id if name == "supersede" else None}
            log.append((answer, 1, name, key))
        if name in ENDS:
            e["state"] = ENDS[name]
        if name == "reinforce" and op["confidence"] is not None:
            e["confidence"] = op["confidence"]
        if name == "edit":
            if op["text"] is not None and op["text"] != e["text"]:
                stale.add(id)
            e.update({c: op[c] for c in ("text", "importance") if op[c] is not None})
        if name == "supersede":
            e["state"] = "superseded"
        if name == "merge":
            for loser, _ in op["losers"]:
                for x, v in [c for c in cited if c[0] == loser and (id, c[1]) not in cited]:
                    cited[id, v] = cited.pop((x, v))
                x = store[loser]
                x.update(state="superseded", supersedes_id=id, entry_version=x["entry_version"] + 1)
                log.append((loser, x["entry_version"], name, None))
        elif name != "edit":
            for v, k in evidence_of:
                cited.setdefault((answer, v), k)
        if name != "create":
            e["entry_version"] += 1
            log.append((id, e["entry_version"], name, None if name == "supersede" else key))
        results.append((op["index"], "applied", answer, store[answer]["entry_version"]))
    return store, sorted((*c, k) for c, k in cited.items()), log, results, stale


def generated(seed, n):
    r = random.Random(seed)
    kinds = ["task", "fact", "hypothesis", "question"]
    entries = [
        dict(entry_id=i, kind=r.choice(kinds), state=r.choice(["active", "active", "active", "resolved"]), entry_version=r.randint(1, 2), scope_kind="repo", scope_owner=i % 2, canonical_key=f"c{i}" if i % 3 == 0 else None, text=f"t{i}", confidence=0.5, importance=0.5, supersedes_id=None)
        for i in range(25)
    ]
    evidence = [(r.randrange(25), v, "tool_result") for v in range(40)]
    audits = [(3, 1, "create", "old-key"), (4, 2, "edit", None)]
    ops = []
    for k in range(n):
        id = r.choice([r.randrange(28), r.randrange(100, 110), None if r.random() < 0.1 else 5])
        op = dict.fromkeys(OP_NAMES) | {
            "index": k * 3, "op": r.choice("create reinforce reinforce resolve retract confirm reject edit edit supersede merge noop nonsense".split()), "entry_id": id, "expected_version": r.choice([1, 1, 2, 3, 4, None]), "kind": r.choice(kinds), "scope_kind": "repo",
            "scope_owner": r.randrange(2), "canonical_key": r.choice([None, None, "c0", "c3", "new1", "new2"]), "text": r.choice([None, "other", "t5"]), "confidence": r.choice([None, 0.9]), "importance": r.choice([None, 0.1]), "actor": r.choice(["user", "router"]),
            "idempotency_key": r.choice([None, None, None, "old-key", "a", "b", f"k{k // 2}"]), "evidence": r.choice([None, [], [(500 + k % 7, "model_claim")], [(501, "user_statement"), (502, "model_claim")]]),
        }
        if op["op"] == "create":
            op["entry_id"] = r.choice([100 + k % 12, 2])
        if op["op"] == "supersede":
            op["new_id"] = r.choice([200 + k, 7])
        if op["op"] == "merge":
            op["losers"] = r.choice([[], [(x, r.choice([1, 1, 2])) for x in r.sample(range(25), r.randint(1, 3)) if x != id]])
        ops.append(op)
    return entries, evidence, audits, ops


def applied(spark, entries, evidence, audits, ops):
    row = lambda names: lambda x: tuple(x[c] for c in names)
    tables = [
        spark.createDataFrame(list(map(row(E_NAMES), entries)), plan.ENTRY), spark.createDataFrame(evidence, "entry_id long, event_id long, evidence_kind string"),
        spark.createDataFrame(audits, "entry_id long, version long, op string, idempotency_key string"), spark.createDataFrame(list(map(row(OP_NAMES), ops)), plan.OP),
    ]
    return plan.apply_plan(*tables)


def test_plans_equal_one_after_the_other(spark):
    outcomes = set()
    for seed, n in ((1, 500), (2, 60), (3, 1)):
        made = generated(seed, n)
        out = applied(spark, *made)
        store, cited, log, results, stale = one_by_one(*made)
        got = sorted(((r["index"], r.outcome, r.entry_id, r.entry_version) for r in out["results"].collect()))
        assert got == results
        assert {r.entry_id: {c: r[c] for c in E_NAMES} for r in out["entries"].collect()} == store
        assert sorted(map(tuple, out["evidence"].select("entry_id", "event_id", "evidence_kind").collect())) == cited
        assert sorted(map(repr, map(tuple, out["audits"].select("entry_id", "version", "op", "idempotency_key").collect()))) == sorted(map(repr, log))
        assert {r.entry_id for r in out["stale"].collect()} == stale
        outcomes |= {r[1] for r in results}
    assert outcomes >= {"applied", "replayed", "version_conflict", "illegal_transition", "canonical_key_conflict", "entry_terminal", "incompatible_scope", "unknown_entry", "empty_merge", "noop"}


def test_no_operations_and_an_empty_store(spark):
    entries, evidence, audits, ops = generated(4, 20)
    out = applied(spark, entries, evidence, audits, [])
    assert out["entries"].count() == len(entries) and out["results"].count() == 0 and out["audits"].count() == 2
    out = applied(spark, [], [], [], ops)
    assert sorted((r["index"], r.outcome) for r in out["results"].collect()) == [x[:2] for x in one_by_one([], [], [], ops)[3]]
