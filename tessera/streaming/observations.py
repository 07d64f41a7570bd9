"""The observation stream: exact and windowed dedup, cursors and idle sessions, for batches and for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_MS, WINDOW_ROWS = 600_000, 512


def exact_dedup(rows: DataFrame, key: str = "dedup_key", order: str = "received_seq") -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    return first.unionByName(rows.filter(F.col(key).isNull()))


def stream_exact_dedup(stream: DataFrame, key: str = "dedup_key", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """As a stream: a key is remembered for `late` of event time."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_dedup(rows: DataFrame, window_ms: int = WINDOW_MS, window_rows: int = WINDOW_ROWS, session: str = "session_id", event: str = "source_event_id", at: str = "at_ms", order: str = "received_seq", late_ms: int | None = None) -> DataFrame:
    """Rows whose event was kept before in their session, not earlier than `window_ms` before or among the last `window_rows` kept,
    go. A dropped row extends nothing, so a session is walked in order; sessions are independent.

    Each (session, event) pair is decided by rows of that pair and by the session's count of kept rows, so sessions are sorted by Spark
    and walked as a stream of batches; a task holds one session's events, never its rows. `late_ms`: rows are at most so far behind the latest time before them;
    events that neither test can find any more are then forgotten, and a task holds the session's window alone.
    """
    columns = rows.columns
    ordered = rows.repartition(F.col(session)).sortWithinPartitions(session, order)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, kept_at, place, n, latest, seen = object(), {}, {}, 0, 0, 0
        for f in frames:
            keep = []
            for s, e, t in zip(f[session], f[event], f[at]):
                if s != who:
                    who, kept_at, place, n, latest, seen = s, {}, {}, 0, t, 0
                latest = max(latest, t)
                if late_ms is not None and n - seen >= window_rows:
                    seen = n
                    for old in [x for x in kept_at if kept_at[x] < latest - late_ms - window_ms and n - place[x] >= window_rows]:
                        del kept_at[old], place[old]
                last = kept_at.get(e) if e is not None else None
                if last is not None and (last >= t - window_ms or n - place[e] < window_rows):
                    keep.append(False)
                    continue
                keep.append(True)
                n += 1
                if e is not None:
                    kept_at[e], place[e] = max(t, last if last is not None else t), n
            yield f[keep]

    return ordered.mapInPandas(walk, rows.schema).select(*columns)


def cursors(rows: DataFrame, session: str = "session_id", seq: str = "received_seq") -> DataFrame:
    return rows.groupBy(session).agg(F.max(seq).alias("last_seq"))


def import_once(stream: DataFrame, target: str, checkpoint: str, key: str = "event_id"):
    """Starts an import that writes each row once: batches carry their number, and a batch that comes again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(rows: DataFrame, gap: str = "24 hours", session: str = "session_id", at: str = "ts") -> DataFrame:
    """Runs of events of a session with less than `gap` between them; works on batches and, with a watermark, on streams."""
    w = F.session_window(F.col(at), gap)
    return rows.groupBy(session, w.alias("w")).agg(F.count("*").alias("n")).select(session, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
