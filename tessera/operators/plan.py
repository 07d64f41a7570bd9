"""A log of operations applied to the store in order: replays by key, expected versions, evidence, audit rows, keys that stay unique.

Operations depend on each other through what they name: entries, canonical keys in a scope, and idempotency keys. Operations that share any of
these, directly or through others, are one component; components don't touch, so they are folded side by side, each in log order by one
pass over its sorted rows. A task holds the entries that one component names, never the store.

Tables. `entries`: `ENTRY`. `evidence`: entry_id, event_id, evidence_kind. `audits`: entry_id, version, op, idempotency_key. `ops`: `OP`, with `index` as the order; `entry_id` is
the entry operated on, the new one for create, the survivor for merge; `new_id` is the replacement for supersede. A null where an
operation needs a value is an unknown entry or a conflict, as it would be for any other wrong value.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ledger import STATE_OF, TERMINAL, TRANSITIONS
from tessera.session import shared_dir

ENTRY = "entry_id long, kind string, state string, entry_version long, scope_kind string, scope_owner long, canonical_key string, text string, confidence double, importance double, supersedes_id long"
OP = (
    "index long, op string, entry_id long, expected_version long, new_id long, kind string, scope_kind string, scope_owner long, canonical_key string, text string, confidence double, importance double, "
    "actor string, idempotency_key string, evidence array<struct<event_id:bigint,evidence_kind:string>>, losers array<struct<entry_id:bigint,expected_version:bigint>>"
)
#: Kinds that a router doesn't make from a model's claims alone.
PROMOTED = ("fact", "decision", "convention", "procedure")
_OUT = "what string, index long, n int, entry_id long, version long, op string, idempotency_key string, outcome string, data string"


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(ops: DataFrame) -> DataFrame:
    """(index, node): what each operation names."""
    entry = lambda c: F.concat(F.lit("e:"), c.cast("string"))
    scope = F.when(F.col("canonical_key").isNotNull() & F.col("op").isin("create", "supersede"), F.concat_ws("\x1f", F.lit("c:"), "scope_kind", F.col("scope_owner").cast("string"), "canonical_key"))
    key = F.concat(F.lit("k:"), F.col("idempotency_key"))
    losers = F.when(F.col("op") == "merge", F.transform("losers", lambda x: entry(x["entry_id"])))
    nodes = F.concat(F.array(entry(F.col("entry_id")), F.when(F.col("op") == "supersede", entry(F.col("new_id"))), scope, key), F.coalesce(losers, F.array().cast("array<string>")))
    return ops.select("index", F.explode(F.array_distinct(F.filter(nodes, lambda x: x.isNotNull()))).alias("node"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of (index, node): nodes that indexes connect have one component, the smallest index among them.

    Each round a node takes the smallest label of its indexes and an index that of its nodes, both summed up before they are dealt, and labels are looked up
    in labels, so rounds grow with the logarithm of the longest chain."""
    labels = _written(links.groupBy("node").agg(F.min("index").alias("label")), "labels")
    before = None
    for _ in range(rounds):
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels.select("node", F.col("label").alias("component"))
        before = now
        least = links.join(labels, "node").groupBy("index").agg(F.min("label").alias("label"))
        jumped = least.join(least.select(F.col("index").alias("label"), F.col("label").alias("_further")), "label", "left").select("index", F.coalesce("_further", "label").alias("label"))
        labels = _written(links.join(jumped, "index").groupBy("node").agg(F.min("label").alias("label")), "labels")
    raise RuntimeError(f"components are not finished after {rounds} rounds")


class _Store:
    """The entries of one component while its operations are applied, and the rows that come of it."""

    def __init__(self) -> None:
        self.entries: dict = {}
        self.evidence: dict = {}
        self.keys: set = set()
        self.replays: dict = {}
        self.changed: set = set()
        self.out: list[tuple] = []

    def take(self, rank: int, x: dict) -> None:
        if rank == 0:
            self.entries[x["entry_id"]] = x
        elif rank == 1:
            self.evidence.setdefault(x["entry_id"], {})[x["event_id"]] = x["evidence_kind"]
        elif rank == 2:
            self.keys.add((x["scope_kind"], x["scope_owner"], x["canonical_key"]))
        elif rank == 3:
            self.replays[x["idempotency_key"]] = (x["entry_id"], x["version"])
        else:
            outcome, entry, version = self.apply(x)
            self.out.append(("result", x["index"], 0, entry, version, x["op"], x.get("idempotency_key"), outcome, None))

    def apply(self, x: dict) -> tuple:
        key = x.get("idempotency_key")
        if x["op"] == "noop":
            return "noop", None, None
        if key is not None and key in self.replays:
            return "replayed", *self.replays[key]
        outcome, entry = getattr(self, x["op"], self.unknown)(x)
        if outcome != "applied":
            return outcome, None, None
        version = self.entries[entry]["entry_version"]
        if key is not None:
            self.replays[key] = (entry, version)
        return outcome, entry, version

    def unknown(self, x: dict) -> tuple:
        return "unknown_op", None

    def wrong(self, id, version, to: str | None = None) -> str | None:
        """Why an entry can't be changed: there is none, its version is another, or it can't come to the state."""
        e = self.entries.get(id)
        if e is None:
            return "unknown_entry"
        if e["entry_version"] != version:
            return "version_conflict"
        if to and e["state"] != to and f"{e['state']}>{to}" not in TRANSITIONS.get(e["kind"], "").split():
            return "illegal_transition"
        return None

    def grow(self, x: dict, id, n: int, key=None, **changes) -> None:
        e = self.entries[id]
        e.update(changes)
        e["entry_version"] += 1
        self.note(x, id, n, key)

    def note(self, x: dict, id, n: int, key=None) -> None:
        self.changed.add(id)
        self.out.append(("audit", x["index"], n, id, self.entries[id]["entry_version"], x["op"], key, None, None))

    def cite(self, x: dict, id) -> None:
        for e in x.get("evidence") or []:
            self.evidence.setdefault(id, {}).setdefault(e["event_id"], e["evidence_kind"])

    def made(self, x: dict, id, supersedes=None) -> str | None:
        cited = x.get("evidence") or []
        if x.get("actor") == "router" and x.get("kind") in PROMOTED and cited and all(e["evidence_kind"] == "model_claim" for e in cited):
            return "model_claim_only"
        scoped = (x.get("scope_kind"), x.get("scope_owner"), x.get("canonical_key"))
        if scoped[2] is not None and scoped in self.keys:
            return "canonical_key_conflict"
        if id is None or id in self.entries:
            return "entry_exists"
        if scoped[2] is not None:
            self.keys.add(scoped)
        self.entries[id] = {
            "entry_id": id, "kind": x.get("kind"), "state": "active", "entry_version": 1, "scope_kind": scoped[0], "scope_owner": scoped[1], "canonical_key": scoped[2], "text": x.get("text"),
            "confidence": x.get("confidence"), "importance": x.get("importance"), "supersedes_id": supersedes,
        }
        self.cite(x, id)
        return None

    def create(self, x: dict) -> tuple:
        id = x.get("entry_id")
        wrong = self.made(x, id)
        if not wrong:
            self.note(x, id, 0, x.get("idempotency_key"))
        return wrong or "applied", id

    def reinforce(self, x: dict) -> tuple:
        id = x.get("entry_id")
        wrong = self.wrong(id, x.get("expected_version"))
        if not wrong:
            self.cite(x, id)
            new = x.get("confidence")
            self.grow(x, id, 0, x.get("idempotency_key"), **({} if new is None else {"confidence": new}))
        return wrong or "applied", id

    def _moved(self, x: dict) -> tuple:
        id, to = x.get("entry_id"), STATE_OF[x["op"]]
        wrong = self.wrong(id, x.get("expected_version"), to)
        if not wrong:
            self.cite(x, id)
            self.grow(x, id, 0, x.get("idempotency_key"), state=to)
        return wrong or "applied", id

    resolve = retract = confirm = reject = _moved

    def edit(self, x: dict) -> tuple:
        id = x.get("entry_id")
        wrong = self.wrong(id, x.get("expected_version"))
        if not wrong and self.entries[id]["state"] in TERMINAL:
            wrong = "entry_terminal"
        if not wrong:
            new = {c: x[c] for c in ("text", "importance") if x.get(c) is not None}
            if "text" in new and new["text"] != self.entries[id]["text"]:
                self.out.append(("stale_text", x["index"], 0, id, None, x["op"], None, None, None))
            self.grow(x, id, 0, x.get("idempotency_key"), **new)
        return wrong or "applied", id

    def supersede(self, x: dict) -> tuple:
        old, new = x.get("entry_id"), x.get("new_id")
        wrong = self.wrong(old, x.get("expected_version"), "superseded") or self.made(x, new, old)
        if not wrong:
            self.note(x, new, 0, x.get("idempotency_key"))
            self.grow(x, old, 1, state="superseded")
        return wrong or "applied", new

    def merge(self, x: dict) -> tuple:
        id, losers = x.get("entry_id"), x.get("losers") or []
        wrong = "empty_merge" if not losers else self.wrong(id, x.get("expected_version"))
        home = self.entries.get(id, {})
        for loser in losers:
            other = self.entries.get(loser.get("entry_id"))
            wrong = wrong or self.wrong(loser.get("entry_id"), loser.get("expected_version"))
            if not wrong and any(other[c] != home[c] for c in ("scope_kind", "scope_owner")):
                wrong = "incompatible_scope"
            wrong = wrong or self.wrong(loser.get("entry_id"), loser.get("expected_version"), "superseded")
        if wrong:
            return wrong, id
        for n, loser in enumerate(losers):
            mine, theirs = self.evidence.setdefault(id, {}), self.evidence.setdefault(loser["entry_id"], {})
            for event in [e for e in theirs if e not in mine]:
                mine[event] = theirs.pop(event)
            self.grow(x, loser["entry_id"], n, state="superseded", supersedes_id=id)
        self.grow(x, id, len(losers), x.get("idempotency_key"))
        return "applied", id

    def rows(self) -> Iterator[tuple]:
        yield from self.out
        for id in self.entries:
            yield ("entry", None, 0, id, None, None, None, None, json.dumps(self.entries[id]))
            for event, kind in self.evidence.get(id, {}).items():
                yield ("evidence", None, 0, id, None, None, None, None, json.dumps({"entry_id": id, "event_id": event, "evidence_kind": kind}))


def _folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _OUT.split(", ")]
    who, store = None, _Store()
    for frame in frames:
        out: list[tuple] = []
        for component, rank, data in zip(frame["component"], frame["rank"], frame["data"]):
            if component != who:
                out.extend(store.rows())
                who, store = component, _Store()
            store.take(rank, json.loads(data))
        yield pd.DataFrame(out, columns=columns, dtype=object)
    yield pd.DataFrame(list(store.rows()), columns=columns, dtype=object)


def apply_plan(entries: DataFrame, evidence: DataFrame, audits: DataFrame, ops: DataFrame) -> dict[str, DataFrame]:
    """`entries` and `evidence` as they are afterwards, `audits` with the new rows, `results` (index, op, outcome, entry_id, entry_version), and `stale` (entry_id), whose
    normalised text no longer holds. What an operation that fails would have changed stays as it was."""
    links = _written(named(ops), "links")
    where = _written(components(links), "components")
    of = lambda kind: where.filter(F.col("node").startswith(f"{kind}:")).select("component", "node")

    def row(rank: int, df: DataFrame, node: Column, kind: str, order: Column, columns: list[str]) -> DataFrame:
        found = df.withColumn("_node", node).join(of(kind).withColumnRenamed("node", "_node"), "_node")
        return found.select("component", F.lit(rank).alias("rank"), order.cast("long").alias("order"), F.to_json(F.struct(*columns)).alias("data"))

    entry = F.concat(F.lit("e:"), F.col("entry_id").cast("string"))
    zero = F.lit(0)
    first = links.groupBy("index").agg(F.min("node").alias("node")).join(where, "node").select("index", "component")
    keyed = F.concat_ws("\x1f", F.lit("c:"), "scope_kind", F.col("scope_owner").cast("string"), "canonical_key")
    e_columns, op_columns = [c.split()[0] for c in ENTRY.split(", ")], ops.columns
    parts = [
        row(0, entries, entry, "e", zero, e_columns), row(1, evidence, entry, "e", F.col("event_id"), ["entry_id", "event_id", "evidence_kind"]),
        row(2, entries.filter("canonical_key is not null").select("scope_kind", "scope_owner", "canonical_key").distinct(), keyed, "c", zero, ["scope_kind", "scope_owner", "canonical_key"]),
        row(3, audits.filter("idempotency_key is not null"), F.concat(F.lit("k:"), F.col("idempotency_key")), "k", F.col("version"), ["entry_id", "version", "idempotency_key"]),
        ops.join(first, "index", "left").select(F.coalesce("component", -1 - F.col("index")).alias("component"), F.lit(4).alias("rank"), F.col("index").alias("order"), F.to_json(F.struct(*op_columns)).alias("data")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    out = _written(rows.repartition("component").sortWithinPartitions("component", "rank", "order").mapInPandas(_folded, _OUT), "applied")
    now = out.filter("what = 'entry'").select(F.from_json("data", ENTRY).alias("r")).select("r.*")
    cited = out.filter("what = 'evidence'").select(F.from_json("data", "entry_id long, event_id long, evidence_kind string").alias("r")).select("r.*")
    touched = now.select("entry_id")
    new = out.filter("what = 'audit'").select("entry_id", "version", "op", "idempotency_key", "index", "n")
    return {
        "entries": entries.select(*e_columns).join(touched, "entry_id", "left_anti").unionByName(now),
        "evidence": evidence.select("entry_id", "event_id", "evidence_kind").join(touched, "entry_id", "left_anti").unionByName(cited),
        "audits": audits.select("entry_id", "version", "op", "idempotency_key", F.lit(None).cast("long").alias("index"), F.lit(0).alias("n")).unionByName(new),
        "results": out.filter("what = 'result'").select("index", "op", "outcome", "entry_id", F.col("version").alias("entry_version")),
        "stale": out.filter("what = 'stale_text'").select("entry_id").distinct(),
    }
