"""Packed exchanges: many small keys travel as sorted arrays, a row for each batch of documents and bucket of keys.

`pack` writes the documents once as compressed batches of a bounded size to the shared folder, so that later rounds see the
same batches even if executors are lost. In a round every batch sends its distinct keys to the buckets they hash to; a bucket
compares what the batches sent and answers each batch. A key that a third of all documents share is one entry a batch, because
batches drop repeats before they send.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm.common import bounded_batches, written

BATCH_BYTES, BATCH_DOCS = 4 << 20, 8000
NO_ID = np.iinfo(np.int64).max
ROWS = "bucket int, batch long, kind int, data binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def squeezed(*arrays: np.ndarray) -> bytes:
    """Equally long arrays in little space: byte by byte of the values, compressed; the first, if it ascends, as differences."""
    import zstandard

    parts = []
    for k, a in enumerate(arrays):
        if not k:
            a = np.diff(a, prepend=a.dtype.type(0))
        parts.append(np.packbits(a).tobytes() if a.dtype == bool else np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes())
    return len(arrays[0]).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unsqueezed(data: bytes, *types) -> list[np.ndarray]:
    import zstandard

    n, at, out = int.from_bytes(data[:8], "little"), 0, []
    raw = zstandard.ZstdDecompressor().decompress(data[8:])
    for k, of in enumerate(types):
        of = np.dtype(of)
        if of == bool:
            size = (n + 7) // 8
            a = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n).astype(bool)
        else:
            size = n * of.itemsize
            a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(of.itemsize, n).T).view(of).ravel()
        at += size
        out.append(a if k else np.cumsum(a, dtype=of))
    return out


class Names:
    """Names of ranges of a sequence of 64-bit values, by prefix doubling: 2k values are named after the names of their halves, any
    other length after the two ranges of the largest power of two that cover it, and the length.

    Pairs are mixed at each step, so that no name is a sum over the values: sequences that a polynomial modulo 2 ** 64 cannot tell
    apart have different names. Only one level is held at a time, so lengths are asked for in ascending order. Ranges are meant
    to be short; whole documents are told apart by `digest`.
    """

    first, second, third = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
    block = 1 << 15

    def __init__(self, values: np.ndarray):
        self.size, self.level = 1, values

    def up_to(self, n: int) -> Names:
        """The level that names ranges of n values."""
        while 2 * self.size <= n:
            count = max(0, len(self.level) - self.size)
            self.level, self.size = self._pairs(count, lambda a, b: (self.level[a:b], self.level[self.size + a : self.size + b]), 0), 2 * self.size
        return self

    def _pairs(self, count: int, halves: Callable[[int, int], tuple], salt: int) -> np.ndarray:
        out = np.empty(count, dtype=np.uint64)
        for at in range(0, count, self.block):  # pieces that stay in the cache
            one, two = halves(at, min(count, at + self.block))
            x = one * self.first
            x += two
            x += np.uint64(salt & (2**64 - 1))
            x ^= x >> np.uint64(32)
            x *= self.second
            x ^= x >> np.uint64(29)
            out[at : at + self.block] = x
        return out

    def every(self, n: int, salt: int = 0) -> np.ndarray:
        """The names of the ranges of n values that start at each place."""
        self.up_to(n)
        by = n - self.size
        return self._pairs(max(0, len(self.level) - by), lambda a, b: (self.level[a:b], self.level[by + a : by + b]), n * int(self.third) + salt)

    def ranges(self, starts: np.ndarray, lengths: np.ndarray, salt: int = 0) -> np.ndarray:
        """The names of ranges by their starts and lengths, all of which this level names."""
        back = lengths - self.size
        return self._pairs(len(starts), lambda a, b: (self.level[starts[a:b]], self.level[starts[a:b] + back[a:b]] + lengths[a:b].astype(np.uint64) * self.third), salt)

    def each(self, starts: np.ndarray, lengths: np.ndarray, salt: int = 0) -> np.ndarray:
        """The names of ranges of any lengths from this level up."""
        out, most = np.zeros(len(starts), dtype=np.uint64), int(lengths.max(initial=0))
        while True:
            of = np.flatnonzero((lengths >= self.size) & (lengths < 2 * self.size))
            if len(of):
                out[of] = self.ranges(starts[of], lengths[of], salt)
            if 2 * self.size > most:
                return out
            self.up_to(2 * self.size)


def digest(data: bytes) -> bytes:
    """128 bits that tell whole documents apart."""
    return hashlib.blake2b(data, digest_size=16).digest()


@dataclass
class Batch:
    ids: np.ndarray
    null: np.ndarray
    lengths: np.ndarray
    text: bytes

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.lengths)))

    def documents(self) -> Iterator[bytes]:
        b = self.bounds
        for i in range(len(self.ids)):
            yield self.text[b[i] : b[i + 1]]


def unpacked(row) -> Batch:
    import zstandard

    return Batch(np.frombuffer(row.ids, np.int64), np.frombuffer(row.null, bool), np.frombuffer(row.lengths, np.int64), zstandard.ZstdDecompressor().decompress(row.text))


def pack(docs: DataFrame, id: str, text: str, batch_bytes: int = BATCH_BYTES, batch_docs: int = BATCH_DOCS) -> DataFrame:
    """(batch, ids, null, lengths, text) rows of at most `batch_bytes` of text, a longer document alone; null texts are empty."""

    def packing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def row():
            null = np.array([i is None for i in ids], dtype=bool)
            return pd.DataFrame([{
                "batch": (task << 32) | seq, "ids": np.array([NO_ID if i is None else i for i in ids], dtype=np.int64).tobytes(), "null": null.tobytes(),
                "lengths": np.array([len(t) for t in texts], dtype=np.int64).tobytes(), "text": zstandard.ZstdCompressor(level=9).compress(b"".join(texts)),
            }])

        for frame in frames:
            for i, t in zip(frame["id"], frame["text"]):
                t = (t or "").encode()
                if ids and (size + len(t) > batch_bytes or len(ids) >= batch_docs):
                    yield row()
                    ids, texts, size, seq = [], [], 0, seq + 1
                ids.append(None if pd.isna(i) else int(i))
                if ids[-1] == NO_ID:
                    raise ValueError(f"the id {NO_ID} stands for null")
                texts.append(t)
                size += len(t)
        if ids:
            yield row()

    if not isinstance(docs.schema[id].dataType, IntegralType):
        raise TypeError(f"ids must be whole numbers; {id} is {docs.schema[id].dataType.simpleString()}")
    bounded_batches(docs.sparkSession)
    # Null longs would reach pandas as floats and lose digits, so the id travels as text where there are nulls to carry.
    rows = docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"))
    return written(rows.mapInPandas(packing, "batch long, ids binary, null binary, lengths binary, text binary"), "packed")


def buckets_for(packed: DataFrame) -> int:
    """A bucket gets the keys of about four batches, whatever the size of the corpus."""
    return max(8, packed.count() // 4)


def split(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each run in an ordered array."""
    if not len(bucket):
        return []
    cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:])]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where new values begin in ordered keys."""
    new = np.zeros(max(0, len(keys[0]) - 1), dtype=bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1)) if len(keys[0]) else np.zeros(0, dtype=np.int64)


def owner_rows(batch: int, kind: int, keys: np.ndarray, ids: np.ndarray, buckets: int, more: np.ndarray | None = None) -> list[tuple]:
    """What a batch sends to learn the smallest id of each key: distinct keys, their smallest ids, and if they have several.

    `more` are 64 more bits of each key.
    """
    if not len(keys):
        return []
    parts = [keys] if more is None else [keys, more]
    order = np.lexsort((ids, *parts[::-1]))
    parts, ids = [p[order] for p in parts], ids[order]
    first = _starts(*parts)
    last = np.concatenate((first[1:], [len(ids)])) - 1
    parts, least, several = [p[first] for p in parts], ids[first], ids[first] != ids[last]
    bucket = (parts[0] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    columns, bucket = [c[order] for c in (parts[0], least, several, *parts[1:])], bucket[order]
    return [(b, batch, kind, squeezed(*[c[s:e] for c in columns])) for b, s, e in split(bucket)]


def owners(rows: list[tuple[int, bytes]], wide: bool = False) -> list[tuple[int, bytes]]:
    """Answers of a bucket: the keys of each batch that documents with a smaller id have too, with the smallest id of all."""
    parts = [(batch, *unsqueezed(data, np.uint64, np.int64, bool, *[np.uint64] * wide)) for batch, data in rows]
    keys, least = [np.concatenate([p[c] for p in parts]) for c in ((1, 4) if wide else (1,))], np.concatenate([p[2] for p in parts])
    order = np.lexsort((least, *keys[::-1]))
    first = _starts(*[k[order] for k in keys])
    smallest = np.empty(len(order), dtype=np.int64)
    smallest[order] = np.repeat(least[order][first], np.diff(np.concatenate((first, [len(order)]))))
    out, at = [], 0
    for batch, k, own, several, *rest in parts:
        best = smallest[at : at + len(k)]
        at += len(k)
        keep = (best < own) | several
        if keep.any():
            out.append((batch, squeezed(k[keep], best[keep], *[r[keep] for r in rest])))
    return out


def wide_owners(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    return owners(rows, wide=True)


def copy_rows(batch: int, kind: int, digests: list[bytes], ids: np.ndarray, buckets: int) -> list[tuple]:
    """`owner_rows` of whole documents, by all 128 bits of their digests."""
    both = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return owner_rows(batch, kind, np.ascontiguousarray(both[:, 0]), ids, buckets, np.ascontiguousarray(both[:, 1]))


def copied(datas, digests: list[bytes], ids: np.ndarray) -> np.ndarray:
    """Which documents equal one with a smaller id, from what `wide_owners` answered; a digest may be empty: not asked."""
    least: dict[bytes, int] = {}
    for d in datas:
        keys, ids_of, more = unsqueezed(d, np.uint64, np.int64, np.uint64)
        least |= {k.to_bytes(8, "little") + m.to_bytes(8, "little"): i for k, m, i in zip(keys.tolist(), more.tolist(), ids_of.tolist())}
    return np.array([least.get(x, i) < i for x, i in zip(digests, ids.tolist())], dtype=bool)


def answers(datas) -> tuple[np.ndarray, np.ndarray]:
    """(keys, smallest ids) in order of the keys, from what `owners` answered."""
    parts = [unsqueezed(d, np.uint64, np.int64) for d in datas]
    keys = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)])
    least = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
    order = np.argsort(keys, kind="stable")
    return keys[order], least[order]


def look_up(wanted: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where `wanted` values occur in ordered `keys`: their places in both. A bitmap turns most away."""
    if not len(keys) or not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marks = np.zeros(1 << 20, dtype=bool)
    marks[(keys >> np.uint64(44)).astype(np.int64)] = True
    at = np.flatnonzero(marks[(wanted >> np.uint64(44)).astype(np.int64)])
    to = np.minimum(np.searchsorted(keys, wanted[at]), len(keys) - 1)
    same = keys[to] == wanted[at]
    return at[same], to[same]


def send(packed: DataFrame, emit: Callable[[int, Batch], list[tuple]]) -> DataFrame:
    def sending(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield pd.DataFrame(emit(row.batch, unpacked(row)), columns=["bucket", "batch", "kind", "data"])

    return packed.mapInPandas(sending, ROWS)


def answer(sent: DataFrame, buckets: int, reply: dict[int, Callable[[list], list]]) -> DataFrame:
    """(bucket, batch, kind, data): what the buckets say to the batches, by the kind of key or the kind that a reply names.

    Buckets are dealt over four times as many partitions, so few meet in a task and tasks do not grow with the corpus.
    """

    def replying(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, part in pdf.groupby("kind"):
            bucket = int(part["bucket"].iloc[0])
            out += [(bucket, batch, as_kind[0] if as_kind else kind, data) for batch, data, *as_kind in reply[kind](list(zip(part["batch"], part["data"])))]
        return pd.DataFrame(out, columns=["bucket", "batch", "kind", "data"])

    return sent.repartition(4 * buckets, "bucket").groupBy("bucket").applyInPandas(replying, ROWS)


def together(packed: DataFrame, buckets: int, replies: DataFrame, then: Callable[[int, Batch, dict[int, list]], pd.DataFrame], schema: str) -> DataFrame:
    """Each batch with the replies to it, by kind; (bucket, data) pairs. A partition gets about four batches."""

    def meeting(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = next(left.itertuples(index=False))
        said: dict[int, list] = {}
        for r in right.itertuples(index=False):
            said.setdefault(int(r.kind), []).append((int(r.bucket), r.data))
        return then(row.batch, unpacked(row), said)

    dealt = lambda rows: rows.repartition(buckets, "batch").groupBy("batch")
    return dealt(packed).cogroup(dealt(replies)).applyInPandas(meeting, schema)
