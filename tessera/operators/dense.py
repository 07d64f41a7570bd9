"""Vector search and the offline embedder."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

DIMS = 256
#: About so many query vectors make a block, and so many points a chunk.
BLOCK, CHUNK = 4096, 16_384
#: A matrix has at most so many bytes, and so many scores are held at a time: of all points of a chunk and some queries of a block.
MATRIX_BYTES, CELLS = 16 << 20, 1 << 20
#: Blocks of queries are broadcast up to so many bytes.
BROADCAST_BYTES = 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def negative_l2(a: Column, b: Column) -> Column:
    """Minus the distance, so that larger is better."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return -F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


METRICS = {"dot": dot, "cosine": cosine, "l2": negative_l2}


def _chunks(vectors: DataFrame, id: str, vector: str, rows: int, tag: Column | None = None) -> DataFrame:
    """(ids, dims, data, tags) of up to `rows` vectors of one dimension that a task read together, as one matrix; `tag`: a text for each."""

    def packing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def matrices() -> Iterator[pd.DataFrame]:
            both = pd.concat(held)
            size = both["v"].map(len).to_numpy()
            for dims in np.unique(size):
                part = both[size == dims]
                step = max(1, min(rows, MATRIX_BYTES // (8 * max(1, int(dims)))))
                for a in range(0, len(part), step):
                    some = part.iloc[a : a + step]
                    yield pd.DataFrame({"ids": [some["id"].to_numpy()], "dims": [int(dims)], "data": [np.stack(some["v"].tolist()).astype(number).tobytes()], "tags": [some["tag"].to_numpy()]})

        for frame in frames:
            held.append(frame.dropna(subset=["v"]))
            if sum(map(len, held)) >= rows:
                yield from matrices()
                held = []
        if sum(map(len, held)):
            yield from matrices()

    kind, number = dict(vectors.dtypes)[id], np.float32 if dict(vectors.dtypes)[vector] == "array<float>" else np.float64
    rows_of = vectors.select(F.col(id).alias("id"), F.col(vector).alias("v"), (F.lit(None) if tag is None else tag).cast("string").alias("tag"))
    return rows_of.mapInPandas(packing, f"ids array<{kind}>, dims int, data binary, tags array<string>")


def _matrix(data: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if len(data) < 8 * rows * dims else np.float64).reshape(rows, dims).astype(np.float64, copy=False)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best scores, ties by the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _l2(x: np.ndarray, q: np.ndarray, k: int, digits: int) -> np.ndarray:
    """(rows of q, rows of x): minus the distance where it can be among the k smallest of a row of q, exact to the last digits, else minus infinity.

    The square's expansion loses digits far from the origin, so it only chooses, with its error bound; what it chooses is computed from differences."""
    size = (q * q).sum(1)[:, None] + (x * x).sum(1)[None]
    rough = q @ x.T
    rough *= -2
    rough += size
    np.maximum(rough, 0, out=rough)
    error = size
    error *= 4 * (x.shape[1] + 2) * np.finfo(float).eps
    out = np.full(rough.shape, -np.inf)
    for j in range(len(q)):
        at = np.arange(len(x))
        if len(x) > k:
            far = np.sqrt(np.partition(rough[j] + error[j], k - 1)[k - 1]) + 2 * 10.0**-digits  # equal once rounded
            at = np.flatnonzero(rough[j] - error[j] <= far * far)
        out[j, at] = -np.sqrt(((x[at] - q[j]) ** 2).sum(1))
    return out


def _scores(x: np.ndarray, q: np.ndarray, metric: str, k: int, digits: int) -> np.ndarray:
    """(rows of q, rows of x), rounded."""
    if metric == "l2":
        s = _l2(x, q, k, digits)
    else:
        s = q @ x.T
        if metric == "cosine":
            n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
            s = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    return np.round(s, digits, out=s) + 0.0


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, asked: np.ndarray, metric: str, k: int, digits: int) -> list[tuple]:
    """(query, ids, scores) of the k best rows of x for each row of q, with the scores of some queries at a time."""
    out, step = [], max(1, CELLS // len(x))
    for a in range(0, len(q), step):
        for j, s in enumerate(_scores(x, q[a : a + step], metric, k, digits), a):
            p = _best(s, ids, k)
            out.append((np.repeat(asked[j : j + 1], len(p)), ids[p], s[p]))
    return out


def nearest(points: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id: str = "vec_id", vector: str = "embedding", query: str = "query_id", query_vector: str = "query_vector", digits: int = 6, chunk: int = CHUNK, kind: str | None = None, kinds: str | None = None) -> DataFrame:
    """(query, id, score, rank): the exact k nearest of each query, by (score, id).

    Points and queries are packed into matrices inside tasks. Every block of queries meets every chunk of points once, by products of
    some of its queries and the chunk, so that a task holds a bounded number of scores, and only the chunk's k best of each query go on, so what is shuffled is k rows a query and chunk. The blocks are
    broadcast where all of them fit `BROADCAST_BYTES`; else the chunks are dealt to them by a shuffled join. Rows without a
    vector are not found and ask nothing; a dimension that differs from the queries' is an error.

    `kind` names a column of the points, `kinds` an array column of the queries: a query then finds points of its kinds alone, chosen before its k best are, so
    that a filter that keeps few never leaves less than there is. A null array asks for every kind, an empty one for none.
    """
    if (kind is None) != (kinds is None):
        raise ValueError("kind and kinds go together")
    wanted = None if kinds is None else F.to_json(F.col(kinds).cast("array<string>"))
    asked = _chunks(queries, query, query_vector, BLOCK, wanted).select(F.col("ids").alias("asked"), F.col("dims").alias("asked_dims"), F.col("data").alias("asked_data"), F.col("tags").alias("wanted"))
    asked = asked.withColumn("_uid", F.monotonically_increasing_id()).persist()
    size, blocks = asked.agg(F.coalesce(F.sum(F.octet_length("asked_data")), F.lit(0)), F.count("*")).first()
    types = dict(queries.dtypes)[query], dict(points.dtypes)[id]

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.dims != row.asked_dims:
                    raise ValueError(f"dimension {row.dims} differs from the queries' {row.asked_dims}")
                x, q = (_matrix(d, len(i), row.dims) for d, i in ((row.data, row.ids), (row.asked_data, row.asked)))
                ids, tags, wants = np.asarray(row.ids), np.asarray(row.tags, object), np.asarray(row.wanted, object)
                asked_ids, found = np.asarray(row.asked), []
                # Queries with the same kinds meet the same points.
                for want in dict.fromkeys(wants.tolist()):
                    mine = np.flatnonzero([w == want for w in wants])
                    here = np.arange(len(x)) if want is None else np.flatnonzero(np.isin(tags.astype(str), json.loads(want)) & (tags != None))  # noqa: E711
                    if not len(here):
                        continue
                    found += _nearest(x if len(here) == len(x) else x[here], ids[here], q[mine], asked_ids[mine], metric, k, digits)
                if found:
                    yield pd.DataFrame(dict(zip(("q", "id", "score"), map(np.concatenate, zip(*found)))))

    # One matrix of either side a row, so few rows make a batch.
    packed = _chunks(points, id, vector, chunk, None if kind is None else F.col(kind)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))))
    # Blocks are numbered by a table of their numbers alone; the matrices stay where they are.
    order = asked.select("_uid").withColumn("block", (F.row_number().over(W.orderBy("_uid")) - 1).cast("int"))
    numbered = asked.join(F.broadcast(order), "_uid").drop("_uid")
    both = packed.join(F.broadcast(numbered) if size <= BROADCAST_BYTES else numbered, "block")
    from tessera.operators.lexical import top

    found = both.mapInPandas(scored, f"q {types[0]}, id {types[1]}, score double")
    return top(found, k, "q", "id").select(F.col("q").alias(query), F.col("id").alias(id), "score", "rank")


def upsert(points: DataFrame, changes: DataFrame, id: str = "vec_id", version: str = "version") -> DataFrame:
    """Latest version of each point wins; both sides have the columns of `points`."""
    both = points.unionByName(changes)
    return both.groupBy(id).agg(F.max_by(F.struct(*both.columns), version).alias("r")).select("r.*")


def delete(points: DataFrame, ids: DataFrame, id: str = "vec_id") -> DataFrame:
    return points.join(ids.select(id).distinct(), id, "left_anti")


# ---- codec


@F.pandas_udf(T.BinaryType())
def encode_le(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_le(blobs: pd.Series) -> pd.Series:
    """Null for a length that is no multiple of four."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4"))


def verified(rows: DataFrame, blob: str = "blob", dimensions: str = "dimensions", checksum: str = "checksum") -> DataFrame:
    """`rows` and `divergence`: length, checksum or null."""
    return rows.withColumn("divergence", F.when(F.octet_length(blob) != 4 * F.col(dimensions), "length").when(F.sha2(blob, 256) != F.col(checksum), "checksum"))


# ---- feature hashing

# The hash's start and prime, and how two words in a row are mixed.
_FNV, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(tokens: list[str]) -> np.ndarray:
    """The 64-bit hash of each token, all of them a byte at a time; few tokens are long, so the longest are left to the end."""
    data = [t.encode() for t in tokens]
    size = np.fromiter(map(len, data), np.int64, len(data))
    order = np.argsort(-size, kind="stable")
    ends, raw = np.cumsum(size), np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    at, size, h = (ends - size)[order], size[order], np.full(len(data), _FNV, dtype=np.uint64)
    for i in range(int(size[0]) if len(size) else 0):
        n = np.searchsorted(-size, -i, side="left")  # tokens with more than i bytes
        h[:n] = (h[:n] ^ raw[at[:n] + i]) * np.uint64(_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def _pairs(h: np.ndarray) -> np.ndarray:
    """The features of two words in a row."""
    a, b = h[:-1], h[1:]
    turned = b << np.uint64(31) | b >> np.uint64(33)
    return ((a ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(_PRIME) ^ turned) * np.uint64(_PRIME)


def embed_texts(texts: list[str | None], dims: int = DIMS) -> list[np.ndarray]:
    """Words and word pairs, each added to or taken from the bucket of its hash by the hash's top bit, then normalised; a text without
    words is the bucket of the text itself. Each distinct word of the list is hashed once."""
    words = [re.findall(r"\w+", (t or "").lower()) or [t or ""] for t in texts]
    empty = [not re.search(r"\w", t or "") for t in texts]
    distinct = list(dict.fromkeys(w for ws in words for w in ws))
    known, out = dict(zip(distinct, fnv1a(distinct))), []
    for ws, none in zip(words, empty):
        h = np.fromiter((known[w] for w in ws), np.uint64, len(ws))
        h = h if none else np.concatenate([h, _pairs(h)])
        sign = np.ones(1) if none else np.where(h >> np.uint64(63), -1.0, 1.0)
        v = np.bincount((h % np.uint64(dims)).astype(np.int64), sign, minlength=dims)
        n = np.linalg.norm(v)
        out.append((v / n if n else v).astype(np.float32))
    return out


def embed_text(text: str | None, dims: int = DIMS) -> np.ndarray:
    return embed_texts([text], dims)[0]


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    return pd.Series(embed_texts(texts.tolist()), index=texts.index, dtype=object)


def backfill(subjects: DataFrame, cached: DataFrame, key: str = "subject_hash", text: str = "text") -> DataFrame:
    """(key, embedding) of the subjects that have no valid vector: corrupt rows count as missing."""
    valid = verified(cached).filter("divergence is null").select(key).distinct()
    todo = subjects.dropDuplicates([key]).join(valid, key, "left_anti")
    return todo.select(key, embed(F.col(text)).alias("embedding"))
