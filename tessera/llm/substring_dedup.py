"""Substring dedup over words by fixed-block anchors.

Every document is cut into non-overlapping blocks of `run // 2` words; the blocks of all documents are the index, and every
rolling window of as many words of every document probes it. A run of `run` words always holds a whole block of the document that
had it first, so each repeat shows as a hit at the same place of both documents. Hits are extended both ways: all runs around
them are compared by their first document, and what is covered by a run that also starts in a document with a smaller
id goes, so maximal repeats go whole. The index tells only 36 or more bits of a block apart, which can add candidates but
loses none; runs are compared by 64 bits. Documents whose words equal those of a smaller id, by 128 bits of a cryptographic hash of all
of them, go whole without being extended.

Nulls have no words; a null id counts as larger than any other. Rows of one id never remove from each other. Rows that repeat stay.
Empty tables give empty results. Only the id and the text are read; the id is a whole number below 2^63 - 1, anything else raises.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.llm.exchange import Batch, Names, answer, answers, buckets_for, copied, copy_rows, digest, look_up, mix, owner_rows, owners, pack, send, split, squeezed, together, unsqueezed, wide_owners

RUN = 50
BLOCK_KEYS, DOC_KEYS, RUN_KEYS = 0, 1, 2
#: Bytes up to which words are named by doubling; longer ones by a digest.
LONG = 127
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """The words of a batch: names, documents and places."""

    def __init__(self, batch: Batch):
        # One space after each document keeps its last word from meeting the next.
        text = b" ".join(batch.documents()) + b" "
        raw = np.frombuffer(text, dtype=np.uint8)
        edge = np.diff(np.concatenate(([True], _SPACE[raw])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        size = ends - starts
        self.name = Names(_BYTES[raw]).each(starts, np.minimum(size, LONG))
        for i in np.flatnonzero(size > LONG).tolist():
            self.name[i] = int.from_bytes(digest(text[starts[i] : ends[i]])[:8], "little")
        begin = batch.bounds[:-1] + np.arange(len(batch.ids))
        self.doc = np.searchsorted(begin, starts, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(batch.ids))
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def runs(self, n: int) -> np.ndarray:
        """Where runs of n words of one document start."""
        if len(self.name) < n:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])


def whole(batch: Batch, which: np.ndarray) -> list[bytes]:
    """Digests of the words of the documents asked for, empty for the others."""
    return [digest(b" ".join(doc.split())) if asked else b"" for doc, asked in zip(batch.documents(), which.tolist())]


def _block_keys(w: Words, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    starts = w.runs(block)
    h = Names(w.name).every(block)[starts]
    return starts, (((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _probe(number: int, batch: Batch, run: int, buckets: int) -> list[tuple]:
    """Sends the distinct window keys of a batch with two bits each: is it a block here, and do several documents have it."""
    w, block = Words(batch), run // 2
    starts, key = _block_keys(w, block, buckets)
    doc = w.doc[starts]
    is_block = ((starts - w.first[doc]) % block == 0).astype(np.uint64)
    packed = np.sort((key << np.uint64(14)) | (doc.astype(np.uint64) << np.uint64(1)) | is_block)
    out = []
    if len(packed):
        key = packed >> np.uint64(14)
        first = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
        last = np.concatenate((first[1:], [len(key)])) - 1
        blocks = np.bitwise_or.reduceat(packed & np.uint64(1), first).astype(bool)
        several = (packed[first] >> np.uint64(1)) != (packed[last] >> np.uint64(1))
        key = key[first]
        rest = key.astype(np.uint32)
        for b, s, e in split((key >> np.uint64(32)).astype(np.int64)):
            out.append((b, number, BLOCK_KEYS, squeezed(rest[s:e], blocks[s:e], several[s:e])))
    long = w.count >= run
    return out + copy_rows(number, DOC_KEYS, [d for d in whole(batch, long) if d], batch.ids[long], buckets)


def _hit_blocks(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Tells each batch which of its windows are blocks that more than one document has."""
    parts = []
    for number, data in rows:
        parts.append((number, *unsqueezed(data, np.uint32, bool, bool)))
    keys = np.concatenate([p[1] for p in parts])
    blocks, several = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(ordered)) + 1)) if len(ordered) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((first, [len(ordered)])))
    hit = np.logical_or.reduceat(blocks[order], first) & ((size > 1) | np.logical_or.reduceat(several[order], first))
    hits = ordered[first][hit]
    out = []
    for number, k, _, _ in parts:
        own = k[np.isin(k, hits, assume_unique=True)]
        if len(own):
            out.append((number, squeezed(own)))
    return out


def _extend(number: int, batch: Batch, said: dict, run: int, buckets: int) -> pd.DataFrame:
    """Sends the runs around each hit with their documents."""
    w, block, out = Words(batch), run // 2, []
    hits = np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | unsqueezed(d, np.uint32)[0].astype(np.uint64) for b, d in said.get(BLOCK_KEYS, [])] or [np.zeros(0, np.uint64)]))
    if len(hits) and len(w.name):
        starts, key = _block_keys(w, block, buckets)
        to = np.minimum(np.searchsorted(hits, key), len(hits) - 1)
        at = starts[hits[to] == key]
        near = np.zeros(len(w.name) + 1, dtype=np.int64)
        np.add.at(near, np.maximum(at - (run - block), w.first[w.doc[at]]), 1)
        np.add.at(near, at + 1, -1)
        runs = w.runs(run)
        runs = runs[np.cumsum(near)[runs] > 0]
        runs = runs[~_copies(w, batch, said, run)[w.doc[runs]]]
        out = owner_rows(number, RUN_KEYS, Names(w.name).every(run)[runs], batch.ids[w.doc[runs]], buckets)
    return pd.DataFrame(out, columns=["bucket", "batch", "kind", "data"])


def _copies(w: Words, batch: Batch, said: dict, run: int) -> np.ndarray:
    """Which documents have all the words of one with a smaller id."""
    return copied([d for _, d in said.get(DOC_KEYS, [])], whole(batch, (w.count >= run) & bool(said.get(DOC_KEYS))), batch.ids)


def removed(batch: Batch, said: dict, run: int) -> tuple[Words, np.ndarray]:
    """The words of a batch and which of them go."""
    w = Words(batch)
    runs = w.runs(run)
    keys, least = answers(d for _, d in said.get(RUN_KEYS, []))
    at, to = look_up(Names(w.name).every(run)[runs], keys)
    start = runs[at]
    start = start[least[to] < batch.ids[w.doc[start]]]
    cover = np.zeros(len(w.name) + 1, dtype=np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + run, -1)
    gone = np.cumsum(cover)[:-1] > 0
    return w, gone | _copies(w, batch, said, run)[w.doc]


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """Per row: id, kept (the words that stay, joined by a space), n_words, n_removed and kept_sha256."""
    packed = pack(docs, id, text)
    buckets = buckets_for(packed)
    first = answer(send(packed, lambda number, batch: _probe(number, batch, run, buckets)), buckets, {BLOCK_KEYS: _hit_blocks, DOC_KEYS: wide_owners})
    extended = together(packed, buckets, first, lambda number, batch, said: _extend(number, batch, said, run, buckets), "bucket int, batch long, kind int, data binary")
    second = answer(extended, buckets, {RUN_KEYS: owners})

    def results(number: int, batch: Batch, said: dict) -> pd.DataFrame:
        w, gone = removed(batch, said, run)
        out = []
        for i, doc in enumerate(batch.documents()):
            a, b = w.first[i], w.first[i + 1]
            lost, found = gone[a:b], doc.split()
            n = int(lost.sum())
            kept = b" ".join(found if not n else [x for x, y in zip(found, lost.tolist()) if not y])
            out.append((None if batch.null[i] else int(batch.ids[i]), kept.decode(), int(b - a), n, hashlib.sha256(kept).hexdigest()))
        frame = pd.DataFrame(out, columns=[id, "kept", "n_words", "n_removed", "kept_sha256"])
        return frame.astype({id: "Int64"})

    copies = first.filter(f"kind = {DOC_KEYS}")
    return together(packed, buckets, copies.unionByName(second), results, f"{id} long, kept string, n_words long, n_removed long, kept_sha256 string")


def op5(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
r AS (SELECT doc_id, p, sha256(array_to_string(w[p:p+49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d)),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS first FROM r),
gone AS (SELECT doc_id, list(DISTINCT q) AS g FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM f WHERE first < doc_id) GROUP BY doc_id),
kept AS (SELECT d.doc_id, w, coalesce(len(g), 0) AS n, CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS k FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
