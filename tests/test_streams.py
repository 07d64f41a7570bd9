"""Streams with keyed state against plain walks, over batches and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import observations, stateful

ROWS = "session_id string, source_event_id string, at_ms long, received_seq long"


def walk(rows, window_ms, window_rows):
    """Rows that are kept: no kept row of their session and event lies in the window of time or among the last rows kept."""
    kept = {}
    for r in sorted(rows, key=lambda r: r[3]):
        mine = kept.setdefault(r[0], [])
        again = r[1] is not None and any(e == r[1] and (t >= r[2] - window_ms or k >= len(mine) - window_rows) for k, (e, t) in enumerate(mine))
        if not again:
            mine.append((r[1], r[2]))
            yield r[3]


def made(seed, n=700):
    r, at, rows = random.Random(seed), 1_700_000_000_000, []
    for k in range(n):
        at += r.choice([0, 1000, 60_000, 300_000])
        rows.append((r.choice("ab"), r.choice([None, *(f"e{i}" for i in range(12))]), at - r.choice([0, 0, 5000, 100_000]), k))
    return rows


def streamed(spark, folder, make, schema, parts, time):
    """Runs the stream anew for each part of the input, from one checkpoint; returns what it has written."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(schema).parquet(f"{folder}/in").withColumn("ts", F.timestamp_millis(time))
        run = make(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(240)
    return spark.read.parquet(f"{folder}/out")


@pytest.fixture
def stateful_session(spark):
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_windowed_dedup_over_restarts(stateful_session, tmp_path):
    spark, rows = stateful_session, made(1)
    parts = [rows[:200], rows[200:201], rows[201:500], rows[500:]]
    out = streamed(spark, tmp_path, lambda s: stateful.stream_windowed_dedup(s, "20 minutes", window_rows=4), ROWS, parts, F.col("at_ms"))
    want = sorted(walk(rows, observations.WINDOW_MS, 4))
    assert sorted(r.received_seq for r in out.collect()) == want and 50 < len(want) < 600
    batch = observations.windowed_dedup(spark.createDataFrame(rows, ROWS), window_rows=4)
    assert sorted(r.received_seq for r in batch.collect()) == want
    forgetful = observations.windowed_dedup(spark.createDataFrame(rows, ROWS), window_rows=4, late_ms=100_000)
    assert sorted(r.received_seq for r in forgetful.collect()) == want
    state = spark.read.format("statestore").option("stateVarName", "kept").load(f"{tmp_path}/state")
    assert 0 < state.count() <= 2 * 12


def test_state_of_a_session_is_bounded(stateful_session, tmp_path):
    """Events that never come again leave the state once they are neither recent nor among the last rows."""
    spark = stateful_session
    rows = [("a", f"e{k}", 1_700_000_000_000 + k * 60_000, k) for k in range(400)]
    streamed(spark, tmp_path, lambda s: stateful.stream_windowed_dedup(s, "1 minute", window_rows=16), ROWS, [rows[i : i + 80] for i in range(0, 400, 80)], F.col("at_ms"))
    held = spark.read.format("statestore").option("stateVarName", "kept").load(f"{tmp_path}/state").count()
    assert 16 <= held <= 80 + 16 + 12, held


def test_payloads_expire_and_envelopes_stay(stateful_session, tmp_path):
    spark, hour = stateful_session, 3_600_000
    start = 1_700_000_000_000
    rows = [("s" + str(k % 3), f"p{k}", start + k * hour) for k in range(100)]
    rows.insert(50, rows[49])  # comes again
    schema = "session_id string, observation_id string, imported_ms long"
    out = streamed(spark, tmp_path, lambda s: stateful.stream_payloads(s, hours=10), schema, [rows[:30], rows[30:60], rows[60:]], F.col("imported_ms"))
    got = [(r.id, r.change) for r in out.collect()]
    assert sorted(i for i, c in got if c == "stored") == sorted({i for _, i, _ in rows})
    expired = {i for i, c in got if c == "expired"}
    assert len(expired) == sum(c == "expired" for _, c in got)
    # Import time has come to hour 99, so what is from hour 89 or before is due.
    assert expired == {f"p{k}" for k in range(90)} or expired == {f"p{k}" for k in range(89)}
    left = spark.read.format("statestore").option("stateVarName", "live").load(f"{tmp_path}/state").count()
    assert left == 100 - len(expired)


# ---- leases


def leased(events, last):
    """The changes of each run by one walk; a lease that is over before the last event's time is stale, once."""
    runs, out = {}, []
    for run, event, at, seq, build, batch in sorted(events, key=lambda e: e[3]):
        x = runs.setdefault(run, {"state": "pending", "attempt": 0, "size": batch, "lease": None, "due": -1, "build": None})

        def say(change, at=at, seq=seq, x=x, run=run):
            out.append((run, at, seq, change, x["attempt"], x["size"]))

        if x["state"] == "running" and x["lease"] <= at:
            x["state"] = "pending"
            say("stale", x["lease"], None)
        if event == "start" and (x["state"] == "pending" or x["state"] == "failed" and x["build"] != build and x["due"] <= at):
            x.update(state="running", lease=at + 120_000, build=None, due=-1)
            say("started")
        elif x["state"] != "running" or event == "start":
            say("refused")
        elif event == "renew":
            x["lease"] = at + 120_000
            say("renewed")
        elif event == "apply":
            x["state"] = "applied"
            say("applied")
        else:
            x["state"] = "failed"
            x["attempt"] += 1
            if event == "overflow" and x["size"] > 1:
                x["size"] //= 2
                say("shrunk")
            elif event == "transient" and x["attempt"] < 8:
                x["due"] = at + (0, 0, 250, 500, 1000, 2000, 4000, 4000)[x["attempt"]]
                say("retry")
            else:
                x["build"] = build
                say("floored" if event == "overflow" else "parked")
    for run, x in runs.items():
        if x["state"] == "running" and x["lease"] <= last:
            out.append((run, x["lease"], None, "stale", x["attempt"], x["size"]))
    return sorted(out, key=repr)


def test_leases_over_restarts(stateful_session, tmp_path):
    spark, r = stateful_session, random.Random(11)
    at, events = 1_700_000_000_000, []
    for k in range(900):
        at += r.choice([0, 100, 300, 5_000, 5_000, 70_000])
        events.append((f"r{r.randrange(6)}", r.choice(["start"] * 5 + ["renew", "apply" if k > 250 else "renew", "transient", "transient", "transient", "overflow", "mechanical" if k % 5 == 0 else "transient"]), at, k, f"b{k // 300}", 8))
    events.append(("late", "start", at + 500_000, 900, "b9", 1))
    schema = "run_id string, event string, at_ms long, seq long, build string, batch long"
    out = streamed(spark, tmp_path, lambda s: stateful.stream_leases(s, "1 second"), schema, [events[:100], events[100:101], events[101:600], events[600:]], F.col("at_ms"))
    got = sorted(((x.run_id, x.at_ms, x.seq, x.change, x.attempt, x.batch) for x in out.collect()), key=repr)
    want = leased(events, at + 499_000)
    assert got == want
    assert {c for _, _, _, c, _, _ in want} == {"started", "renewed", "applied", "retry", "parked", "shrunk", "floored", "stale", "refused"}
