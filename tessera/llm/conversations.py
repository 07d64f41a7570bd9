"""Repair of a conversation's structure: the cheapest edits that give `(system? (user assistant)+)?`, by A* on the lattice of edits.

A node of the lattice is (rows read, state of the pattern): 0 nothing yet, 1 after system, 2 after user, 3 after assistant; 0 and 3 may end. A row is
kept (K), given the role that its place wants (R) or deleted (D), or a row is inserted before it (I). The heuristic is the sum over the rows to come
of what none of them escapes: the deletion of each blank or duplicate row, the charge of each truncated one. It is never too high and never drops by more than
an edit costs, so the first time that a node leaves the queue, which is keyed (cost plus heuristic, audit), its cost is the least and its
audit the first of that cost: one audit of a node is never the beginning of another of equal cost, so audits compare as wholes.

Conversations may be of any length, so none is gathered. Rows are sorted by (conversation, turn, role, text) over range partitions and get their place
there; `BLOCK` places are a block. A task searches a block's conversations. One that may go on in another block is solved for
each state to begin with and each to end with; such pieces join in order, `FAN` at a time, as an audit of two pieces is the
audit of the one and that of the other. Duplicates are rows that aren't the first place of their (conversation, role, text). The repaired rows
pass a task in order, a batch at a time, and are hashed on the way; it holds the conversation's audit, which the result has as one value.

Nulls: a null text or role counts as one space; null conversations are one conversation, null turns come first. Rows of the same turn
follow each other by role and text; identical ones are duplicates. A role is told by its first character; a row whose role has none
or another than s, u or a can't be kept. Empty texts and texts of white space are blank. Very long texts are held a few at a time. An empty table gives an
empty result. Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, written

BLOCK, FAN = 512, 64
#: The costs of edits and the charge for a truncated row that isn't deleted.
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
CHARGE = 1
#: State after a row with an initial; what else a state's place may want is not in the pattern.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: State after the row of the place's own role, and that role.
FORCED = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
ENDS = (0, 3)
NONE = r"[\x20\x09-\x0D]"


def search(rows: list[tuple[str, str]], start: int, goals: tuple[int, ...] = ENDS) -> dict[int, tuple[int, str]]:
    """{goal: (cost, audit)} from a state over (initial, fault) rows; with the goals `ENDS` only the best of both, under -1."""
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + {"blank": COST["D"], "duplicate": COST["D"], "truncated": CHARGE}.get(rows[i][1], 0)
    queue, done, found = [(rest[0], "", 0, start)], set(), {}
    while queue:
        key, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = key - rest[i]
        if i == n and state in goals:
            if goals == ENDS:
                return {-1: (cost, audit)}
            found[state] = (cost, audit)
            if len(found) == len(goals):
                return found
        to = [("I", i, FORCED[state][0], COST["I"])]
        if i < n:
            initial, fault = rows[i]
            to.append(("D", i + 1, state, COST["D"]))
            if fault not in ("blank", "duplicate"):
                charge = CHARGE if fault == "truncated" else 0
                to.append(("R", i + 1, FORCED[state][0], COST["R"] + charge))
                if (state, initial) in NEXT:
                    to.append(("K", i + 1, NEXT[state, initial], COST["K"] + charge))
        for letter, j, after, more in to:
            if (j, after) not in done:
                heapq.heappush(queue, (cost + more + rest[j], audit + letter, j, after))
    return found


PIECE = "conv string, place long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, paths array<struct<start:int,goal:int,cost:long,audit:string>>"
LEGAL = ("su", "ua", "au")


def _listed(paths: dict) -> list[dict]:
    return [{"start": s, "goal": g, "cost": int(c), "audit": a} for (s, g), (c, a) in paths.items()]


def _piece(conv, place: int, rows: list, whole: bool) -> tuple:
    """What a run of rows (turn, initial, fault) adds up to; `whole`: it is a conversation of its own."""
    kinds = [(r[1], r[2]) for r in rows]
    if whole:
        found = {(0, -1): search(kinds, 0)[-1]}
    else:
        found = {(s, g): path for s in range(4) for g, path in search(kinds, s, (0, 1, 2, 3)).items()}
    turns = [r[0] for r in rows if r[0] is not None]
    count = lambda fault: sum(r[2] == fault for r in rows)
    illegal = sum(a[1] + b[1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    return (conv, place, len(rows), count("blank"), count("duplicate"), count("truncated"), illegal, rows[0][1], rows[-1][1], turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), _listed(found))


def _solved(block: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """The pieces of a block; only its first and last conversation can have rows in others."""
    block = block.sort_values("pos")
    runs: list[tuple] = []
    for conv, pos, turn, initial, fault in block[["conv", "pos", "turn", "initial", "fault"]].itertuples(index=False):
        turn = None if turn is None else int(turn)
        if not runs or runs[-1][0] != conv:
            runs.append((conv, int(pos), []))
        runs[-1][2].append((turn, initial, fault))
    out = [_piece(c, p, rows, 0 < k < len(runs) - 1) for k, (c, p, rows) in enumerate(runs)]
    return pd.DataFrame(out, columns=columns, dtype=object)


def _joined(group: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """Pieces of a conversation put together in order."""
    pieces = group.sort_values("place")
    total = None
    for x in pieces.to_dict("records"):
        x["paths"] = {(p["start"], p["goal"]): (p["cost"], p["audit"]) for p in x["paths"]}
        for c in ("low", "high"):
            x[c] = None if pd.isna(x[c]) else int(x[c])
        if total is None:
            total = x
            continue
        for c in ("n", "blank", "duplicate", "truncated"):
            total[c] += x[c]
        total["illegal"] += x["illegal"] + (total["last"] + x["first"] not in LEGAL)
        total["turns"] += x["turns"] - (total["high"] is not None and total["high"] == x["low"])
        total["low"] = x["low"] if total["low"] is None else total["low"]
        total["high"] = total["high"] if x["high"] is None else x["high"]
        total["last"] = x["last"]
        both: dict = {}
        for (s, m), (cost, audit) in total["paths"].items():
            for g in range(4):
                if (m, g) in x["paths"]:
                    more = x["paths"][m, g]
                    both[s, g] = min(both.get((s, g), (float("inf"), "")), (cost + more[0], audit + more[1]))
        total["paths"] = both
    total["paths"] = _listed(total["paths"])
    return pd.DataFrame([[total[c] for c in columns]], columns=columns, dtype=object)


def placed(turns: DataFrame) -> DataFrame:
    """`turns` (conv, turn, role, text, gone) with `pos`, ascending in order of (conv, turn, role, text), and initial, written. Rows that are `gone` keep a
    place, so that every conversation has one."""
    ranged = turns.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    return written(ranged.select("*", F.monotonically_increasing_id().alias("pos"), F.substring("role", 1, 1).alias("initial")), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, pos, turn, initial, fault) of the rows of `placed` that aren't gone; fault is blank, duplicate, truncated or empty."""
    there = rows.filter(~F.col("gone"))
    firsts = there.groupBy("conv", "role", F.sha2("text", 256).alias("h")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    last = F.substring(F.rtrim(F.regexp_replace("text", NONE, " ")), -1, 1)
    known = there.select("conv", "pos", "turn", "initial", last.alias("last"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    return known.join(firsts, "pos", "left").select("conv", "pos", "turn", "initial", fault.alias("fault"))


def solved(found: DataFrame) -> DataFrame:
    """A row for each conversation of `faults`: the columns of `PIECE`, with the cheapest path from 0 to an end alone."""
    schema, columns = PIECE, [c.split()[0] for c in PIECE.split(", ")]
    block = F.floor(F.col("pos") / BLOCK)
    # Numbers that may be null would come to pandas as floats.
    pieces = found.withColumn("turn", F.col("turn").cast("string")).withColumn("block", block).groupBy("block").applyInPandas(lambda b: _solved(b, columns), schema)
    pieces = written(pieces, "pieces")
    whole = F.exists("paths", lambda p: p["goal"] == -1)
    done, parts, width = pieces.filter(whole), pieces.filter(~whole), BLOCK
    while (parts.groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > FAN:
        width *= FAN
        parts = written(parts.groupBy("conv", F.floor(F.col("place") / width).alias("part")).applyInPandas(lambda k: _joined(k, columns), schema), "pieces")
    ended = parts.groupBy("conv").applyInPandas(lambda k: _joined(k, columns), schema)
    best = F.array_min(F.transform(F.filter("paths", lambda p: (p["start"] == 0) & p["goal"].isin(-1, *ENDS)), lambda p: F.struct(p["cost"], p["audit"])))
    return done.unionByName(ended).withColumn("best", best).select(*[c for c in columns if c != "paths"], F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))


def repaired(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv, sha256) of the repaired `role:text` lines. A conversation's audit comes before its rows, in one sorted stream."""
    none = F.lit(None).cast("string")
    lines = rows.filter(~F.col("gone")).select("conv", "pos", none.alias("audit"), "role", "text")
    stream = paths.select("conv", F.lit(-1).cast("long").alias("pos"), "audit", none.alias("role"), none.alias("text")).unionByName(lines)
    stream = stream.repartition("conv").sortWithinPartitions("conv", "pos")

    def hashed(batches):
        state: dict = {}

        def add(role, text):
            state["sha"].update((("" if state["blank"] else "\n") + f"{role}:{text}").encode())
            state["blank"] = False

        def inserted():
            while state["audit"][state["at"] : state["at"] + 1] == "I":
                state["at"] += 1
                after, role = FORCED[state["state"]]
                add(role, "")
                state["state"] = after

        def ended():
            inserted()
            return (state["conv"], state["sha"].hexdigest())

        for batch in batches:
            out = []
            for conv, audit, role, text in batch[["conv", "audit", "role", "text"]].itertuples(index=False):
                if isinstance(audit, str):
                    if state:
                        out.append(ended())
                    state = {"conv": conv, "audit": audit, "at": 0, "state": 0, "sha": hashlib.sha256(), "blank": True}
                    continue
                inserted()
                letter = state["audit"][state["at"]]
                state["at"] += 1
                if letter == "R":
                    after, role = FORCED[state["state"]]
                elif letter == "K":
                    after = NEXT[state["state"], role[:1]]
                if letter != "D":
                    add(role, text)
                    state["state"] = after
            yield pd.DataFrame(out, columns=["conv", "sha256"])
        if state:
            yield pd.DataFrame([ended()], columns=["conv", "sha256"])

    return stream.mapInPandas(hashed, "conv string, sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """One row for each conv of `turns` (conv, turn, role, text, gone): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    Rows that are `gone` count for nothing, but that their conversation is listed."""
    bounded_batches(turns.sparkSession)
    kind = turns.schema["conv"].dataType
    rows = placed(turns.select(F.col("conv").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone"))
    paths = written(solved(faults(rows)), "paths")
    out = paths.withColumnRenamed("conv", "_conv").join(repaired(rows, paths.select("conv", "audit")), F.col("_conv").eqNullSafe(F.col("conv"))).drop("_conv")
    every = rows.select(F.col("conv").alias("_conv")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return every.join(out, F.col("_conv").eqNullSafe(F.col("conv")), "left").select(
        F.col("_conv").cast(kind).alias("conv"), zero(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps"), *[zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turn, role, text, gone) of a table of conversations, with one row in four damaged by the crc32 of `conv:turn`."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv).alias("conv"), "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space(conv), F.lit(":"), space("turn"))) % 20).alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("how") == 0, "").otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("how") == 0).alias("gone"), "how")
    return rows.withColumn("_copy", F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy", "how")


def op11(spark, sf_dir):
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).withColumnRenamed("conv", "conv_id")
