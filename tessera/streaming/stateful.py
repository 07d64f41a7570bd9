"""Keyed state over event time: dedup in a window of rows and time, and payloads that expire.

Both run as `transformWithStateInPandas`, so their state is in the stream's checkpoint and a restarted stream goes on where it was. Rows of a session have
to come in stream order over batches; in a batch they are put in order. Sessions are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tessera.streaming.observations import WINDOW_MS, WINDOW_ROWS

#: Hours that a payload is kept after its import.
PAYLOAD_HOURS = 72
#: Sessions share so many groups of the state of payloads. A checkpoint holds for the number that it was made with.
BUCKETS = 1024
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> None:
    """Map state and timers need this store; it is an option of the session, as for any stream with them."""
    spark.conf.set(_PROVIDER, _ROCKSDB)


class _Dedup(StatefulProcessor):
    """Per session: how many rows were kept, and of each event when and as which of them it was kept last.

    An entry goes when neither test can find it any more: it isn't among the last rows, and it is older than the window before
    the watermark, behind which no row comes. So a session holds `rows` entries and those of the window, whatever its length.
    """

    def __init__(self, window_ms: int, window_rows: int, columns: tuple[str, str, str]):
        self.window_ms, self.window_rows, self.columns = window_ms, window_rows, columns

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", "n long, pruned long")
        self.kept = handle.getMapState("kept", "event string", "at long, place long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        event, at, order = self.columns
        batch = pd.concat(list(rows)).sort_values(order, kind="stable")
        n, pruned = self.count.get() if self.count.exists() else (0, 0)
        known: dict = {}
        keep = []
        for e, t in zip(batch[event], batch[at]):
            if e is not None and e not in known:
                known[e] = self.kept.getValue((e,)) if self.kept.containsKey((e,)) else None
            last = known.get(e)
            again = last is not None and (last[0] >= t - self.window_ms or n - last[1] < self.window_rows)
            keep.append(not again)
            if not again:
                n += 1
                if e is not None:
                    known[e] = (int(max(t, last[0]) if last else t), n)
                    self.kept.updateValue((e,), known[e])
        floor = timerValues.getCurrentWatermarkInMs() - self.window_ms
        if n - pruned >= self.window_rows:
            for (e,), (t, place) in list(self.kept.iterator()):
                if t < floor and n - place >= self.window_rows:
                    self.kept.removeKey((e,))
            pruned = n
        self.count.update((n, pruned))
        yield batch[keep]

    def close(self) -> None:
        pass


def stream_windowed_dedup(stream: DataFrame, late: str, window_ms: int = WINDOW_MS, window_rows: int = WINDOW_ROWS, session: str = "session_id", event: str = "source_event_id", at: str = "at_ms", order: str = "received_seq") -> DataFrame:
    """`observations.windowed_dedup` as a stream. Rows that come later than `late` behind the latest event time are dropped by the watermark.

    `stream` has a timestamp column `ts` for the watermark."""
    prepared(stream.sparkSession)
    marked = stream.withWatermark("ts", late)
    return marked.groupBy(session).transformWithStateInPandas(_Dedup(window_ms, window_rows, (event, at, order)), stream.schema, "Append", "eventTime")


class _Payloads(StatefulProcessor):
    """Per bucket of sessions: the payloads that live, and one timer, for the first that expires; a bucket without a timer has none.

    Each group and each call to the state is a trip to the JVM, so sessions share buckets, and a bucket's payloads are read, added and put back together, once in a batch."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", "session string, id string, expires long")

    def _await(self, due: int) -> None:
        """A timer fires once the watermark is beyond it; a payload is due when the watermark has come to its time."""
        self.handle.registerTimer(due - 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timers = list(self.handle.listTimers())
        known = {(s, i) for s, i, _ in self.live.get()} if timers else set()
        due = None
        for batch in rows:
            new = []
            for s, i, t in zip(batch["session_id"].tolist(), batch["id"].tolist(), batch["at"].tolist()):
                if (s, i) not in known:
                    known.add((s, i))
                    new.append((s, i, int(t)))
            if new:
                self.live.appendList([(s, i, t + self.keep_ms) for s, i, t in new])
                first = min(t for _, _, t in new) + self.keep_ms
                due = first if due is None else min(due, first)
            yield pd.DataFrame([(s, i, "stored", t) for s, i, t in new], columns=["session_id", "id", "change", "at_ms"])
        if due is not None and (not timers or due - 1 < min(timers)):
            for t in timers:
                self.handle.deleteTimer(t)
            self._await(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        live = list(self.live.get())
        stay = [x for x in live if x[2] > now]
        if stay:
            self.live.put(stay)
            self._await(min(expires for _, _, expires in stay))
        else:
            self.live.clear()
        yield pd.DataFrame([(s, i, "expired", expires) for s, i, expires in live if expires <= now], columns=["session_id", "id", "change", "at_ms"])

    def close(self) -> None:
        pass


def stream_payloads(stream: DataFrame, hours: float = PAYLOAD_HOURS, session: str = "session_id", id: str = "observation_id", at: str = "imported_ms") -> DataFrame:
    """(session_id, id, change, at_ms): `stored` when a payload comes in, and `expired` once import time has passed its `hours`. Envelopes are another table and stay.

    Import time, the column `ts`, only grows, so it is its own watermark. Sessions are dealt over `BUCKETS`; a batch reads what lives in the buckets that it has rows of."""
    prepared(stream.sparkSession)
    rows = stream.select(F.col(session).cast("string").alias("session_id"), F.col(id).cast("string").alias("id"), F.col(at).alias("at"), "ts").withWatermark("ts", "0 seconds")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)))
    schema = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("id", T.StringType()), T.StructField("change", T.StringType()), T.StructField("at_ms", T.LongType())])
    return rows.groupBy("bucket").transformWithStateInPandas(_Payloads(int(hours * 3_600_000)), schema, "Append", "eventTime")


# ---- leases

# How long a lease lasts, waits between attempts, and the attempt at which a failure counts as one that won't pass.
LEASE_MS, WAIT_MS, WAIT_MOST_MS, LAST_ATTEMPT = 120_000, 250, 4_000, 8
RUN = "state string, attempt int, lease_until long, next_attempt_at long, failed_build string, batch long, floored boolean"
CHANGE = "run_id string, at_ms long, seq long, change string, attempt int, batch long"


def wait_ms(attempt: int) -> int:
    """0 after the first failure, then doubling up to a limit."""
    return 0 if attempt <= 1 else min(WAIT_MS << min(attempt - 2, 62), WAIT_MOST_MS)


def lease_step(run: tuple | None, event: str, at: int, build: str, batch: int) -> tuple[tuple, list[tuple[str, int]]]:
    """A run after an event, and what changed, with the time of it: started, renewed, applied, retry, parked, shrunk, floored, stale or refused.

    A run that runs and whose lease is over is stale before anything else happens. It starts when it is new, stale, or failed and due, unless it is parked: a failure that
    won't pass waits for another build. An overflow halves the window, which then may start at once, down to one row, which is parked."""
    state, attempt, lease, due, failed, size, floored = run or ("pending", 0, None, None, None, batch, False)
    changes = []
    if state == "running" and lease <= at:
        state, lease = "pending", None
        changes.append(("stale", at if event == "expire" else min(at, run[2])))
    if event == "expire":
        return (state, attempt, lease, due, failed, size, floored), changes
    change = "refused"
    if event == "start" and (state == "pending" or state == "failed" and failed != build and (due is None or due <= at)):
        state, lease, due, failed, floored, change = "running", at + LEASE_MS, None, None, False, "started"
    elif event == "renew" and state == "running":
        lease, change = at + LEASE_MS, "renewed"
    elif event == "apply" and state == "running":
        state, lease, change = "applied", None, "applied"
    elif event in ("transient", "mechanical", "overflow") and state == "running":
        state, lease, attempt = "failed", None, attempt + 1
        if event == "overflow" and size > 1:
            size, due, change = max(1, size // 2), None, "shrunk"
        elif event == "transient" and attempt < LAST_ATTEMPT:
            due, change = at + wait_ms(attempt), "retry"
        else:
            failed, floored = build, event == "overflow"
            change = "floored" if floored else "parked"
    return (state, attempt, lease, due, failed, size, floored), [*changes, (change, at)]


class _Leases(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN)

    def _applied(self, key, events) -> pd.DataFrame:
        run = self.run.get() if self.run.exists() else None
        before = run[2] if run else None
        out = []
        for event, at, seq, build, batch in events:
            run, changes = lease_step(run, event, int(at), build, int(batch))
            out += [(key[0], when, None if change == "stale" else int(seq), change, run[1], run[5]) for change, when in changes]
        self.run.update(run)
        if run[2] != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if run[2] is not None:
                self.handle.registerTimer(run[2])
        return pd.DataFrame(out, columns=["run_id", "at_ms", "seq", "change", "attempt", "batch"]).astype({"seq": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        yield self._applied(key, batch[["event", "at_ms", "seq", "build", "batch"]].itertuples(index=False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        run = self.run.get()
        if run[0] == "running" and run[2] is not None and run[2] <= at:
            after, changes = lease_step(run, "expire", at, "", 1)
            self.run.update(after)
            yield pd.DataFrame([(key[0], when, None, change, after[1], after[5]) for change, when in changes], columns=["run_id", "at_ms", "seq", "change", "attempt", "batch"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def stream_leases(stream: DataFrame, late: str = "0 seconds") -> DataFrame:
    """`CHANGE` of runs from their events (run_id string, event string, at_ms, seq, build, batch, ts): start, renew, apply, transient, mechanical, overflow. Events of a run come in order
    of `seq`; a lease that nothing renews is over once event time has passed it."""
    prepared(stream.sparkSession)
    rows = stream.select("run_id", "event", "at_ms", "seq", "build", "batch", "ts").withWatermark("ts", late)
    return rows.groupBy("run_id").transformWithStateInPandas(_Leases(), CHANGE, "Append", "eventTime")
