"""Framed spool segments as a Spark data source: `<root>/<session>/<number>.seg`, read in batches or as a stream.

    spark.dataSource.register(SpoolSource)
    frames = spark.read.format("spool").load(root)

A segment has a header and then frames, each with its length and checksum in front. Large segments are read in byte ranges: a range walks the
lengths from the segment's start and decodes the frames that begin in it. Small ones are read many to a task. Rows are `SCHEMA`: one for each frame with its status, and one, without
a payload, for what stops a segment. `accepted` keeps what an importer may take: of each session, in order, everything before the first
stop. As a stream the position is a place in each segment, at the end of its last whole frame.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

# The format of a segment. Header: magic, version and flags as 16-bit numbers, 8 reserved bytes. Frame: length and CRC-32C of the payload as
# 32-bit numbers, and the payload; all little-endian.
MAGIC, VERSION, HEADER, PREFIX, MOST = b"LRSP", 1, 16, 8, 1 << 20
POLYNOMIAL = 0x82F63B78
SCHEMA = "session string, segment int, offset long, length int, status string, payload binary"
WRITE_SCHEMA = "session string, segment int, seq long, frame binary"
#: Fields of a frame's JSON, each of which must be there, null or not; no other may be.
PAYLOAD = T.StructType(
    [T.StructField("format_version", T.IntegerType()), T.StructField("captured_at", T.LongType()), T.StructField("paths", T.ArrayType(T.StringType())), T.StructField("redaction_version", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in "source_event_id dedup_key event_type session_id agent_id turn_id batch_id worktree_root commit evidence_kind trust payload short_evidence_excerpt".split()]
)
#: A segment is read in ranges of so many bytes, and so many are decoded at a time.
RANGE, CHUNK = 64 << 20, 4 << 20
#: A task reads ranges of segments up to so many bytes together, each counted with so many for its opening; rows of several make a batch of at most so many.
TASK, OPENING, ROWS = 16 << 20, 16 << 10, 8192
#: Stops of up to so many sessions are broadcast; beyond that they are joined by shuffle.
BROADCAST_STOPS = 100_000
#: A batch of a stream takes at most so many bytes of each segment.
STREAMED = 64 << 20


# ---- checksums

_BLOCK = 64


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> np.uint32(1) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
    return t


_BYTE = _table()


def _step(crc: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _BYTE[(crc ^ byte) & 0xFF] ^ (crc >> np.uint32(8))


def _skips() -> np.ndarray:
    """What each byte of a checksum becomes after `_BLOCK` zero bytes: checksums are linear, so a block is skipped by four lookups."""
    crc = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).reshape(-1)
    for _ in range(_BLOCK):
        crc = _step(crc, 0)
    return crc.reshape(4, 256)


_SKIP = _skips()


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """The checksum of each payload. All blocks of all payloads go through the table together, then each payload's blocks are added up in order."""
    out = np.zeros(len(payloads), np.uint32)
    size = np.fromiter(map(len, payloads), np.int64, len(payloads))
    for i in np.flatnonzero(size < 4):
        crc = np.array([0xFFFFFFFF], np.uint32)
        for b in payloads[i]:
            crc = _step(crc, b)
        out[i] = crc[0] ^ np.uint32(0xFFFFFFFF)
    order = np.flatnonzero(size >= 4)
    if not len(order):
        return out
    order = order[np.argsort(-size[order], kind="stable")]
    blocks = -(-size[order] // _BLOCK)
    ends = np.cumsum(blocks)
    data = np.zeros(int(ends[-1]) * _BLOCK, np.uint8)
    for k, i in enumerate(order):  # zeros in front of a message change nothing, and the start value is that of its first four bytes
        at = int(ends[k]) * _BLOCK - len(payloads[i])
        data[at : at + len(payloads[i])] = np.frombuffer(payloads[i], np.uint8)
        data[at : at + 4] ^= 0xFF
    data = data.reshape(-1, _BLOCK)
    crc = np.zeros(len(data), np.uint32)
    for j in range(_BLOCK):
        crc = _step(crc, data[:, j])
    first, total = ends - blocks, crc[ends - blocks]
    for k in range(1, int(blocks[0])):
        n = int(np.searchsorted(-blocks, -k, side="left"))  # payloads with more than k blocks
        t = total[:n]
        total[:n] = _SKIP[0][t & 0xFF] ^ _SKIP[1][t >> 8 & 0xFF] ^ _SKIP[2][t >> 16 & 0xFF] ^ _SKIP[3][t >> 24] ^ crc[first[:n] + k]
    out[order] = total ^ np.uint32(0xFFFFFFFF)
    return out


@F.pandas_udf(T.BinaryType())
def framed(payloads: pd.Series) -> pd.Series:
    """Each payload as a frame; null for what is null or too long for one."""
    data = [None if p is None or len(p.encode()) > MOST else p.encode() for p in payloads]
    sums = crc32c([d or b"" for d in data])
    return pd.Series([None if d is None else len(d).to_bytes(4, "little") + int(c).to_bytes(4, "little") + d for d, c in zip(data, sums)])


# ---- reading


def _files(root: str) -> tuple[fs.FileSystem, list[tuple[str, int, str, int]]]:
    """(session, number, path, size) of each segment."""
    system, top = fs.FileSystem.from_uri(root)
    found = []
    for info in system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
        parts = info.path.rsplit("/", 2)
        if info.is_file and info.extension == "seg" and parts[2][:-4].isdigit() and not parts[1].startswith((".", "_")):
            found.append((parts[1], int(parts[2][:-4]), info.path, info.size))
    return system, sorted(found)


def _head(data: bytes) -> str | None:
    """What is wrong with a segment's header."""
    if len(data) < HEADER:
        return "torn"
    if data[:4] != MAGIC:
        return "bad_magic"
    return "unsupported_version" if int.from_bytes(data[4:6], "little") > VERSION else None


def _walk(file, at: int, start: int, stop: int, size: int) -> Iterator[tuple[int, int, int, bytes | None, str | None]]:
    """(offset, length, checksum, payload, stop's status) of frames that begin from `start` to before `stop`; `at` is where some frame begins."""
    buffer, base = b"", at
    while at < min(stop, size):
        inside = at - base
        if inside + PREFIX > len(buffer):
            file.seek(at)
            buffer, base, inside = file.read(CHUNK), at, 0
        if len(buffer) - inside < PREFIX:
            yield at, len(buffer) - inside, 0, None, "torn"
            return
        length, crc = int.from_bytes(buffer[inside : inside + 4], "little"), int.from_bytes(buffer[inside + 4 : inside + 8], "little")
        if length > MOST:
            if at >= start:
                yield at, length & 0x7FFFFFFF, crc, None, "oversize"
            return
        if at + PREFIX + length > size:
            if at >= start:
                yield at, size - at, crc, None, "torn"
            return
        if at >= start:
            if inside + PREFIX + length > len(buffer):
                file.seek(at)
                buffer, base, inside = file.read(max(CHUNK, PREFIX + length)), at, 0
            yield at, length, crc, buffer[inside + PREFIX : inside + PREFIX + length], None
        at += PREFIX + length


class Segment:
    """A range of a segment; `known` is where some frame of it begins."""

    def __init__(self, session: str, number: int, path: str, start: int, stop: int, known: int):
        self.session, self.number, self.path, self.start, self.stop, self.known = session, number, path, start, stop, known


class Segments(InputPartition):
    """What a task reads."""

    def __init__(self, parts: list[Segment]):
        self.parts = parts


def dealt(ranges: Iterator[tuple[Segment, int]]) -> list[Segments]:
    """Ranges with their bytes, in order, as partitions. Ranges of a segment that follow each other in a partition are read as one."""
    parts, weight = [Segments([])], 0
    for r, size in ranges:
        held = parts[-1].parts
        if held and weight + size + OPENING > TASK:
            parts.append(Segments([]))
            held, weight = parts[-1].parts, 0
        if held and held[-1].path == r.path and held[-1].stop == r.start:
            held[-1].stop = r.stop
        else:
            held.append(r)
            weight += OPENING
        weight += size
    return parts


def _frames(system: fs.FileSystem, part: Segment) -> Iterator[tuple[int, int, int, bytes | None, str | None]]:
    """As `_walk`, of a range."""
    with system.open_input_file(part.path) as file:
        size = file.size()
        wrong = _head(file.read(HEADER))
        if not wrong:
            yield from _walk(file, max(HEADER, part.known), part.start, part.stop, size)
        elif part.start <= HEADER:
            yield 0, min(size, HEADER), 0, None, wrong


def _read(root: str, parts: list[Segment]) -> Iterator[pa.RecordBatch]:
    system, _ = fs.FileSystem.from_uri(root)
    schema = pa.schema([("session", pa.string()), ("segment", pa.int32()), ("offset", pa.int64()), ("length", pa.int32()), ("status", pa.string()), ("payload", pa.binary())])

    def batch(rows: list) -> pa.RecordBatch:
        sums = crc32c([r[3] or b"" for _, r in rows]).tolist()
        status = [s or ("ok" if c == crc else "bad_checksum") for (_, (_, _, crc, _, s)), c in zip(rows, sums)]
        columns = [[p.session for p, _ in rows], [p.number for p, _ in rows], [r[0] for _, r in rows], [r[1] for _, r in rows], status, [r[3] for _, r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    held, weight = [], 0
    for part in parts:
        for row in _frames(system, part):
            held.append((part, row))
            weight += len(row[3] or b"")
            if weight >= CHUNK or len(held) >= ROWS:
                yield batch(held)
                held, weight = [], 0
    if held:
        yield batch(held)


class _Reader(DataSourceReader):
    def __init__(self, root: str, width: int):
        self.root, self.width = root, width

    def partitions(self) -> list[Segments]:
        return dealt((Segment(s, n, p, a, a + self.width, 0), min(self.width, size - a)) for s, n, p, size in _files(self.root)[1] for a in range(0, max(size, 1), self.width))

    def read(self, partition: Segments) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition.parts) if partition.parts else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are {path: place}, each at the beginning of a frame that isn't there yet."""

    def __init__(self, root: str, most: int):
        self.root, self.most, self.seen = root, most, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, found = _files(self.root)
        for _, _, path, size in found:
            at = self.seen.get(path, 0)
            if size <= at or size < HEADER:
                continue
            with system.open_input_file(path) as file:
                if at == 0:
                    if _head(file.read(HEADER)):
                        self.seen[path] = HEADER  # its one row says why
                        continue
                    at = HEADER
                for offset, length, _, payload, stop in _walk(file, at, at, at + self.most, size):
                    at = offset if payload is None else offset + PREFIX + length
                    if stop == "oversize":
                        at += 1  # nothing after it can be read, and this place is passed once
            self.seen[path] = at
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Segments]:
        self.seen = {**start, **self.seen}
        ranges = []
        for path, stop in sorted(end.items()):
            if stop > start.get(path, 0):
                session, number = path.rsplit("/", 2)[1:]
                at = start.get(path, 0)
                ranges.append((Segment(session, int(number[:-4]), path, at, stop, at), stop - at))
        return dealt(ranges)

    def read(self, partition: Segments) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition.parts) if partition.parts else iter(())


# ---- writing


class _Done(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str, str]]):
        self.moves = moves


class _Writer(DataSourceArrowWriter):
    """Rows come in order of (session, segment, seq), all rows of a segment in one task. Files get their names when all tasks are done."""

    def __init__(self, root: str):
        self.root, self.folder = root, f"_written-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Done:
        system, top = fs.FileSystem.from_uri(self.root)
        moves, stream, now = [], None, None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("session", "segment", "frame")))
            for at, frames in itertools.groupby(rows, key=lambda r: r[:2]):
                if at != now:
                    if stream:
                        stream.close()
                    if not moves:
                        system.create_dir(f"{top}/{self.folder}", recursive=True)
                    now = at
                    temporary = f"{top}/{self.folder}/{uuid.uuid4().hex}"
                    stream = system.open_output_stream(temporary)
                    stream.write(MAGIC + VERSION.to_bytes(2, "little") + bytes(10))
                    moves.append((temporary, f"{top}/{at[0]}", f"{at[1]:06}.seg"))
                stream.write(b"".join(f for _, _, f in frames))
        if stream:
            stream.close()
        return _Done(moves)

    def commit(self, messages: list) -> None:
        system, top = fs.FileSystem.from_uri(self.root)
        moves = [x for m in messages if m for x in m.moves]
        for folder in {f for _, f, _ in moves}:
            system.create_dir(folder, recursive=True)
        for temporary, folder, name in moves:
            system.move(temporary, f"{folder}/{name}")
        if system.get_file_info(f"{top}/{self.folder}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/{self.folder}")

    def abort(self, messages: list) -> None:
        system, top = fs.FileSystem.from_uri(self.root)
        if system.get_file_info(f"{top}/{self.folder}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/{self.folder}")


class SpoolSource(DataSource):
    """Options: path, `range` (bytes of a segment for a task), `streamed` (bytes of each segment for a batch of a stream)."""

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], int(self.options.get("streamed", STREAMED)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def write_spool(frames: DataFrame, root: str) -> None:
    """`frames`: `WRITE_SCHEMA`. Segments are dealt over tasks whole; each is bounded by whoever numbers them."""
    frames.sparkSession.dataSource.register(SpoolSource)
    rows = frames.select("session", F.col("segment").cast("int"), F.col("seq").cast("long"), "frame")
    rows.repartition("session", "segment").sortWithinPartitions("session", "segment", "seq").select("session", "segment", "seq", "frame").write.format("spool").mode("append").save(root)


def read_spool(spark: SparkSession, root: str, width: int = RANGE) -> DataFrame:
    """`SCHEMA` rows of all segments below `root`."""
    spark.dataSource.register(SpoolSource)
    return spark.read.format("spool").option("range", str(width)).load(root)


def stream_spool(spark: SparkSession, root: str, most: int = STREAMED) -> DataFrame:
    spark.dataSource.register(SpoolSource)
    return spark.readStream.format("spool").option("streamed", str(most)).load(root)


def parsed(frames: DataFrame) -> DataFrame:
    """The frames with `envelope`, their JSON; whole frames whose payload isn't what it should be get the status not_utf8, malformed or version_mismatch."""
    text = F.col("payload").cast("string")
    valid = F.is_valid_utf8(text)
    # A field that is missing, or one too many, makes a frame malformed.
    names = F.array_sort(F.json_object_keys(text))
    whole = F.coalesce(names == F.array(*[F.lit(c) for c in sorted(PAYLOAD.names)]), F.lit(False))
    made = F.when((F.col("status") == "ok") & valid & whole, F.from_json(text, PAYLOAD))

    def judged(envelope: Column) -> Column:
        needed = F.lit(True)
        for c in ("format_version", "source_event_id", "event_type", "captured_at", "session_id", "evidence_kind", "trust", "paths"):
            needed = needed & envelope[c].isNotNull()
        status = F.when(F.col("status") != "ok", F.col("status")).when(~valid, "not_utf8").when(~F.coalesce(needed, F.lit(False)), "malformed").when(envelope["format_version"] != VERSION, "version_mismatch").otherwise("ok")
        return F.struct(envelope.alias("envelope"), status.alias("status"))

    # Each use of the envelope would parse it again: the lambda has it once, and filters don't pass the generator.
    rows = frames.select("*", F.explode_outer(F.transform(F.array(made), judged)).alias("_judged"))
    return rows.select(*[F.col("_judged.status").alias(c) if c == "status" else c for c in frames.columns], "_judged.envelope")


def accepted(frames: DataFrame) -> DataFrame:
    """Of each session the good frames before its first stop: a frame that isn't ok, or a segment whose number doesn't follow on the one before.

    The frames are read twice: for the first stop of each segment, and for what comes before that of the session. Stops are few, so they are what is joined;
    frames of a session are never gathered."""
    last = frames.groupBy("session", "segment").agg(F.min(F.when(F.col("status") != "ok", F.col("offset"))).alias("_bad"))
    gap = F.col("segment") != F.coalesce(F.lag("segment").over(W.partitionBy("session").orderBy("segment")) + 1, F.lit(1))
    stops = last.withColumn("offset", F.when(gap, F.lit(-1).cast("long")).otherwise(F.col("_bad"))).filter("offset is not null")
    first = stops.groupBy("session").agg(F.min(F.struct("segment", "offset")).alias("_stop")).persist()
    few = first.count() <= BROADCAST_STOPS
    rows = frames.filter("status = 'ok'").join(F.broadcast(first) if few else first, "session", "left")
    return rows.filter(F.col("_stop").isNull() | (F.struct("segment", "offset") < F.col("_stop"))).drop("_stop")


def stalled(frames: DataFrame) -> DataFrame:
    """(session, segment, offset, status) where an import stops for good: the session's first stop, unless it is a torn tail, which may still be written."""
    first = frames.filter("status <> 'ok'").groupBy("session").agg(F.min(F.struct("segment", "offset", "status")).alias("s"))
    return first.select("session", "s.*").filter("status <> 'torn'")

