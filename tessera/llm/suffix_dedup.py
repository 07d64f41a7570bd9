"""Substring dedup over bytes by prefix doubling of a sparse set of suffixes.

Sorting the suffixes that start at every byte would cost many times the input in each round, so the suffixes are those that
content itself chooses: each run of `run` bytes picks the smallest of its 6-byte names, the rightmost of equal ones, so two equal
runs pick the same place. Ranks are refined at growing offsets, and a position is followed only while it isn't unique:
names of 6 bytes order the positions (offsets 1, 2, 4, ... up to the run's width, by doubling minima); at 28 bytes, to the
right of a position and to its left, buckets sort (rank, context) pairs of all documents and drop what occurs once; at the full
context, the union of the runs that picked the position, equal pairs are settled by their first document; only where one
28-byte rank has several full contexts, at the borders of repeats, are runs ranked one by one at `run` bytes, the threshold.
A byte goes if a run that covers it also starts in a document with a smaller id.

Ranks are names of 64 bits that grow by doubling, 2k bytes from the names of their halves. At 28 bytes 36 bits or more of them travel, where
a false match only adds work, with 40 bits of the full context, which tell a border: two contexts of one rank that agree in those and not
in the rest would pass for one, once in 10^12 such pairs. Documents equal to one with a smaller id, by 128 bits of a cryptographic
hash of all their bytes, go whole without being refined.

Nulls are empty; a null id counts as larger than any other. Rows of one id never remove from each other. Rows that repeat stay.
Empty tables give empty results. Only the id and the text are read; the id is a whole number below 2^63 - 1, anything else raises.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import barred, written
from tessera.llm.exchange import Batch, Names, answer, answers, buckets_for, copied, copy_rows, digest, look_up, mix, owner_rows, owners, pack, send, split, squeezed, together, unsqueezed, wide_owners

RUN, GRAM = 50, 6
CONTEXT_KEYS, DOC_KEYS, REPEAT_KEYS, BORDER_KEYS = 0, 1, 2, 3
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = 31


class Suffixes:
    """The chosen positions of a batch: at, the runs from `low` to `high` that picked each, and the ranks of their contexts.

    `full` is the rank of a position's full context, which includes where in it the position is. `ranks` are those of half contexts, to
    the right for runs that start near the position, to the left for the others, and `of` the position of each.
    """

    def __init__(self, batch: Batch, run: int):
        self.raw = np.frombuffer(batch.text, dtype=np.uint8)
        n = len(self.raw)
        self.bounds, self.run = batch.bounds, run
        self.at = self.low = self.high = self.doc = self.of = np.zeros(0, dtype=np.int64)
        self.full = self.ranks = np.zeros(0, dtype=np.uint64)
        if n < run:
            return
        names = Names(_BYTES[self.raw])
        picked = self._picked(names.every(GRAM))
        across = np.uint64(1 << 40)
        for end in self.bounds[1:-1].tolist():  # no run reaches into the next document
            picked[max(0, end - run + 1) : end] = across
        first = np.concatenate(([0], np.flatnonzero(picked[1:] != picked[:-1]) + 1))
        last = np.concatenate((first[1:], [len(picked)])) - 1
        inside = picked[first] != across
        self.low, self.high = first[inside], last[inside]
        self.at = ((1 << _PLACE) - 1) - picked[self.low].astype(np.int64)
        del picked, first, last
        self.doc = np.searchsorted(self.bounds, self.at, side="right") - 1
        reach = (run - GRAM) // 2
        left, right = np.flatnonzero(self.low <= self.at - reach), np.flatnonzero(self.high >= self.at - reach)
        sides = [names.up_to(k).ranges(at, np.full(len(at), k), salt) for at, k, salt in ((self.at[left] - reach, reach + GRAM, 5), (self.at[right], run - reach, 3))]
        self.ranks, self.of = np.concatenate(sides[::-1]), np.concatenate([right, left])
        self.whole_runs = Names(names.up_to(run).level)
        self.whole_runs.size = names.size
        self.full = mix(names.each(self.low, self.high - self.low + run, salt=2) + (self.at - self.low).astype(np.uint64))

    def _picked(self, least: np.ndarray) -> np.ndarray:
        """For each run the place of the smallest name in it, counted down."""
        mask, run = np.uint64((1 << _PLACE) - 1), self.run
        # The place counts down in the low bits, so the rightmost of equal names is the smallest.
        least &= ~mask
        least |= np.arange((1 << _PLACE) - 1, (1 << _PLACE) - 1 - len(least), -1, dtype=np.uint64)
        n, width, have = len(least) + GRAM - 1, run - GRAM + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        picked = np.minimum(least[: n - run + 1], least[width - have : width - have + n - run + 1])
        picked &= mask
        return picked

    def runs(self, starts: np.ndarray) -> np.ndarray:
        """The ranks of single runs."""
        return self.whole_runs.ranges(starts, np.full(len(starts), self.run), salt=7) if len(starts) else np.zeros(0, dtype=np.uint64)


def _keys(ranks: np.ndarray, buckets: int) -> np.ndarray:
    return (((ranks >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (ranks & np.uint64(0xFFFFFFFF))


def whole(batch: Batch, which: np.ndarray) -> list[bytes]:
    """Digests of the documents asked for, empty for the others."""
    return [digest(doc) if asked else b"" for doc, asked in zip(batch.documents(), which.tolist())]


def _send_contexts(number: int, batch: Batch, run: int, buckets: int) -> list[tuple]:
    """Sends distinct (rank, 40 bits of the full context) pairs and if several documents of the batch have them."""
    s = Suffixes(batch, run)
    key, tag = _keys(s.ranks, buckets), (s.full >> np.uint64(24))[s.of]
    doc = s.doc[s.of]
    order = np.lexsort((doc, tag, key))
    key, tag, doc, out = key[order], tag[order], doc[order], []
    if len(key):
        first = np.concatenate(([0], np.flatnonzero((np.diff(key) != 0) | (np.diff(tag) != 0)) + 1))
        last = np.concatenate((first[1:], [len(key)])) - 1
        key, tag, several = key[first], tag[first], doc[first] != doc[last]
        rest, low, high = key.astype(np.uint32), tag.astype(np.uint32), (tag >> np.uint64(32)).astype(np.uint8)
        for b, x, y in split((key >> np.uint64(32)).astype(np.int64)):
            out.append((b, number, CONTEXT_KEYS, squeezed(rest[x:y], low[x:y], high[x:y], several[x:y])))
    long = batch.lengths >= run
    return out + copy_rows(number, DOC_KEYS, [d for d in whole(batch, long) if d], batch.ids[long], buckets)


def _rank_contexts(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Tells each batch which of its ranks aren't unique, and which of those have several full contexts."""
    parts = [(number, *unsqueezed(data, np.uint32, np.uint32, np.uint8, bool)) for number, data in rows]
    rank, low, high, several = [np.concatenate([p[c] for p in parts]) for c in (1, 2, 3, 4)]
    order = np.argsort(rank, kind="stable")
    rank, several, tag = rank[order], several[order], (high[order].astype(np.uint64) << np.uint64(32)) | low[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(rank)) + 1))
    end = np.concatenate((first[1:], [len(rank)]))
    least, most = np.minimum.reduceat(tag, first), np.maximum.reduceat(tag, first)
    shared = ((end - first) > 1) | np.logical_or.reduceat(several, first)
    ranks, border = rank[first][shared], (least != most)[shared]
    out = []
    for number, k, *_ in parts:
        own = np.unique(k)
        to = np.minimum(np.searchsorted(ranks, own), max(0, len(ranks) - 1))
        hit = ranks[to] == own if len(ranks) else np.zeros(len(own), dtype=bool)
        at_border = hit & border[to] if len(ranks) else hit
        for which, kind in ((hit & ~at_border, CONTEXT_KEYS), (at_border, BORDER_KEYS)):
            if which.any():
                out.append((number, squeezed(own[which]), kind))
    return out


def _followed(s: Suffixes, said: dict, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which positions aren't unique yet, and which are at borders."""
    shared, border = np.zeros(len(s.at), dtype=bool), np.zeros(len(s.at), dtype=bool)
    key = _keys(s.ranks, buckets)
    for kind, flags in ((CONTEXT_KEYS, (shared,)), (BORDER_KEYS, (shared, border))):
        keys = np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | unsqueezed(d, np.uint32)[0].astype(np.uint64) for b, d in said.get(kind, [])] or [np.zeros(0, np.uint64)]))
        if len(keys) and len(key):
            hit = s.of[keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key]
            for f in flags:
                f[hit] = True
    return shared, border


def _runs_of(s: Suffixes, which: np.ndarray) -> np.ndarray:
    """The starts of all runs that picked the positions."""
    low, n = s.low[which], s.high[which] - s.low[which] + 1
    if not len(n):
        return np.zeros(0, dtype=np.int64)
    return np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def _copies(batch: Batch, said: dict, run: int) -> np.ndarray:
    return copied([d for _, d in said.get(DOC_KEYS, [])], whole(batch, (batch.lengths >= run) & bool(said.get(DOC_KEYS))), batch.ids)


def _send_repeats(number: int, batch: Batch, said: dict, run: int, buckets: int) -> pd.DataFrame:
    """Sends the full contexts that aren't unique and, at borders, single runs, with their documents."""
    s = Suffixes(batch, run)
    shared, border = _followed(s, said, buckets)
    alive = ~_copies(batch, said, run)[s.doc]
    full = s.full[shared & alive]
    starts = _runs_of(s, np.flatnonzero(border & alive))
    doc = np.searchsorted(s.bounds, starts, side="right") - 1
    keys = np.concatenate([full, s.runs(starts)])
    ids = np.concatenate([batch.ids[s.doc[shared & alive]], batch.ids[doc]])
    return pd.DataFrame(owner_rows(number, REPEAT_KEYS, keys, ids, buckets), columns=["bucket", "batch", "kind", "data"])


def removed(batch: Batch, said: dict, run: int, buckets: int) -> tuple[Suffixes, np.ndarray]:
    """The bytes of a batch that go."""
    s = Suffixes(batch, run)
    cover = np.zeros(len(s.raw) + 1, dtype=np.int32)
    keys, least = answers(d for _, d in said.get(REPEAT_KEYS, []))
    at, to = look_up(s.full, keys)
    at = at[least[to] < batch.ids[s.doc[at]]]
    np.add.at(cover, s.low[at], 1)
    np.add.at(cover, s.high[at] + run, -1)
    _, border = _followed(s, said, buckets)
    starts = _runs_of(s, np.flatnonzero(border))
    at, to = look_up(s.runs(starts), keys)
    starts = starts[at]
    starts = starts[least[to] < batch.ids[np.searchsorted(s.bounds, starts, side="right") - 1]]
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + run, -1)
    gone = np.cumsum(cover)[:-1] > 0
    copy = np.flatnonzero(_copies(batch, said, run))
    for i in copy:
        gone[s.bounds[i] : s.bounds[i + 1]] = True
    return s, gone


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """Per row: id, kept (the bytes that stay), n_bytes, n_removed, n_spans and kept_sha256."""
    packed = pack(docs, id, text)
    buckets = buckets_for(packed)
    first = answer(send(packed, lambda number, batch: _send_contexts(number, batch, run, buckets)), buckets, {CONTEXT_KEYS: _rank_contexts, DOC_KEYS: wide_owners})
    second = answer(
        together(packed, buckets, first, lambda number, batch, said: _send_repeats(number, batch, said, run, buckets), "bucket int, batch long, kind int, data binary"),
        buckets,
        {REPEAT_KEYS: owners},
    )

    def results(number: int, batch: Batch, said: dict) -> pd.DataFrame:
        s, gone = removed(batch, said, run, buckets)
        out = []
        for i in range(len(batch.ids)):
            a, b = s.bounds[i], s.bounds[i + 1]
            lost = gone[a:b]
            spans = int(np.count_nonzero(np.diff(np.concatenate(([0], lost.astype(np.int8)))) == 1))
            kept = s.raw[a:b][~lost].tobytes() if spans else s.raw[a:b].tobytes()
            out.append((None if batch.null[i] else int(batch.ids[i]), kept, int(b - a), int(lost.sum()), spans, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=[id, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({id: "Int64"})

    needed = first.filter(f"kind <> {CONTEXT_KEYS}")
    return together(packed, buckets, needed.unionByName(second), results, f"{id} long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def doubled(docs: DataFrame, id: str = "doc_id", text: str = "text", run: int = RUN, start: int = 4) -> DataFrame:
    """(id, at): every byte at which a string of `run` bytes starts that also starts in a document with a smaller id.

    Prefix doubling over all positions, in DataFrame functions: strings of `start` bytes are ranked by their value; in each round Spark
    sorts the pairs of ranks at a position and at a growing offset behind it and ranks the pairs that occur twice; positions whose pair is
    unique are dropped. It states the rule that `deduplicate` applies, position by position, but sorts every byte of the corpus, which
    costs about a hundred times the input: it is for small corpora and for tests. Nulls as there.
    """
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.struct(F.col(id).isNull().alias("last"), F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("hash")).alias("doc"), data.alias("data"))
    at = F.when(F.octet_length("data") >= run, F.sequence(F.lit(0), F.octet_length("data") - start)).otherwise(F.array().cast("array<int>"))
    places = barred(rows).select("doc", "data", F.explode_outer(at).alias("at")).filter("at is not null")
    now = places.select("doc", "at", F.conv(F.hex(F.substr("data", F.col("at") + 1, F.lit(start))), 16, 10).cast("bigint").alias("rank"))
    size = start
    while size < run:
        by = min(size, run - size)
        behind = W.partitionBy("doc").orderBy("at").rangeBetween(by, by)
        pairs = written(now.withColumn("next", F.first("rank").over(behind)).filter("next is not null"), "pairs")
        twice = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).filter("n > 1").orderBy("rank", "next")
        ranks = twice.select("rank", "next", F.monotonically_increasing_id().alias("new"))  # ascends with the order of the pairs
        now, size = written(pairs.join(ranks, ["rank", "next"]).select("doc", "at", F.col("new").alias("rank")), "ranks"), size + by
    who = F.struct("doc.last", "doc.id")
    least = now.groupBy("rank").agg(F.min(who).alias("least"), F.max(who).alias("most")).filter("least < most").drop("most")
    return now.join(least, "rank").filter(F.col("least") < who).select(F.col("doc.id").alias(id), "at")


def op7(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
r AS (SELECT doc_id, p, md5(substr(x, 2 * p - 1, 100)) AS k FROM (SELECT doc_id, x, unnest(range(1, CAST(len(x) / 2 AS BIGINT) - 48)) AS p FROM d)),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS first FROM r),
s AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM f WHERE first < doc_id),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM s),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, island),
parts AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS prev FROM spans),
cut AS (
  SELECT d.doc_id, any_value(x) AS x, count(a) AS n_spans, coalesce(sum(b - a), 0) AS n_removed, max(b) AS last,
         coalesce(string_agg(substr(x, 2 * prev - 1, 2 * (a - prev)), '' ORDER BY a), '') AS head
  FROM d LEFT JOIN parts USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, CAST(len(x) / 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(head || CASE WHEN last IS NULL THEN x ELSE substr(x, 2 * last - 1) END)) AS kept_sha256
FROM cut
"""
