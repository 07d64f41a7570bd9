"""SimHash near-dedup by segment popcounts.

A fingerprint has 64 bits, each the majority of that bit over the hashes of a text's shingles. Its 32 two-bit segments are
mapped to their bit counts, a point with 32 coordinates; the Manhattan distance of two points is at most the number of differing
bits. The coordinates form `blocks` groups. Points at a distance of at most `bits` agree in all but `bits` groups, so each
point is filed in the grid cells that fix the coordinates of the remaining groups, and near points meet in a cell. In a cell the
Manhattan bound goes first, then the exact count of differing bits. Only a spanning forest leaves a task, never all pairs: a
breadth-first search compares each fingerprint with those not yet reached. Equal fingerprints are one node, however many texts
share them.

`similar` asks for a share of common shingles instead, and finds every link. Two independent fingerprints, each filed in a few grids of
its own, connect the dense groups first: 128 bits of what meets are compared, and each bucket sends the shortest edges that connect its
candidates. What fingerprints miss comes from the shingles themselves: two sets that share `least` of their shingles share one of the first
`n - least * n + 1` of either in any order of shingles that all sets keep, so sets are filed under these keys. Each is first held against
one set of each of its keys, chosen by hash; then all pairs of a key that no links connect yet are held against each other. Before that
counts, their sizes and the parities of their shingles over 512 places, which bound the number of shingles they don't share from below,
(4096 for long sets) must allow it. In all cases an edge counts only if the sets of shingles, 64 bits each, are as similar as asked.

Nulls and texts without words have fingerprint zero and are linked like any other. A null id never names a component unless all
its ids are null. Rows that repeat stay. Empty tables give empty results. Only the id and the text are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, dropped, written
from tessera.llm.graph import components

SHINGLE, BITS, BLOCKS, SEED = 4, 4, 8, 42
#: Cells of up to so many fingerprints are compared together.
SMALL = 128
#: Entries that a task gathers before it sends them, and that a bucket gets.
HELD, DEALT = 2_000_000, 500_000
#: The same where a forest is taken of what meets: an entry is in up to `SMALL` pairs.
CLOSE_HELD, CLOSE_DEALT = 500_000, 125_000
#: 64-bit words of the parities of a set of shingles.
PARITIES = 8
#: Sets of more shingles than this fill those places; pairs of them are also held against each other by so many words.
LONG, LONG_PARITIES = 600, 64
#: The order of shingles puts what is frequent last, so that few sets share a key. One text in `ORDERED_BY` says what is; any order finds the same links.
ORDERED_BY, OFTEN, ORDERED = 16, 4, 50_000
ODD = np.uint64(0x5555555555555555)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """A hash for each run of `shingle` words; texts with fewer words have one, texts without words none."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, dtype="<u8")
    joined, size = memoryview(b" ".join(found)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(found))
    return np.fromiter((size(joined[a:b], SEED) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())), dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that most of the hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 bits as an unsigned number."""
    return majority(shingles(text, shingle))


def sketch(h: np.ndarray) -> tuple[int, int, int]:
    """A hash of the set of shingles, and two independent fingerprints of it."""
    import xxhash

    other = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    other = (other ^ (other >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return xxhash.xxh64_intdigest(h.tobytes(), SEED), majority(h), majority(other ^ (other >> np.uint64(31)))


def parities(h: np.ndarray, words: int = PARITIES) -> np.ndarray:
    """Whether an odd number of shingles falls on each of 64 * `words` places. Two sets differ in at least as many shingles as places."""
    odd = np.bincount((h % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def prefix(h: np.ndarray, least: float, often: np.ndarray) -> np.ndarray:
    """The shingles of which a set that shares `least` has one, if it keeps the same order: `often` (sorted) last, else by value."""
    if not len(h):
        return h
    late = np.isin(h, often, assume_unique=True) if len(often) else np.zeros(len(h), dtype=bool)
    due = max(1, int(np.ceil(least * len(h) - 1e-6)))
    return np.concatenate([h[~late], h[late]])[: len(h) - due + 1]


def segment_counts(prints: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 two-bit segments, two bits each, in one word."""
    return (prints & ODD) + ((prints >> np.uint64(1)) & ODD)


def manhattan(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Manhattan distance of segment counts. Coordinates are 0, 1 or 2: written as 00, 01 and 11, differing bits are distances."""
    unary = lambda c: c | ((c >> np.uint64(1)) & ODD)
    return np.bitwise_count(unary(a) ^ unary(b))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id).alias("id"), prints(F.col(text)).alias("fp"))


def _forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges that connect what differs in at most `bits` bits, found from one fingerprint at a time."""
    out, rest = [], prints
    counts = segment_counts(rest)
    while len(rest) > 1:
        queue, rest, counts = [rest[0]], rest[1:], counts[1:]
        while queue and len(rest):
            at = queue.pop()
            near = manhattan(counts, segment_counts(at)) <= bits
            near[near] = np.bitwise_count(rest[near] ^ at) <= bits
            if near.any():
                reached = rest[near]
                out += [(int(at), int(x)) for x in reached]
                queue += list(reached)
                rest, counts = rest[~near], counts[~near]
    return out


def _buckets(prints: DataFrame, cells: int, dealt: int = DEALT) -> int:
    """As many that a bucket gets about `dealt` entries, however many fingerprints there are, and no fewer than the session's partitions."""
    return max(8, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-prints.count() * cells // dealt))


def links(prints: DataFrame, bits: int = BITS, blocks: int = BLOCKS, buckets: int | None = None) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) that connect all that differ in at most `bits` bits."""
    chosen = [np.array(c) for c in combinations(range(blocks), blocks - bits)]
    buckets = buckets or _buckets(prints, len(chosen))
    width = 64 // blocks // 2 * 2

    def filed(prints: list[np.ndarray]) -> pd.DataFrame:
        """One row a bucket: the cells of all combinations that fall into it, and the fingerprints in them."""
        fp = np.concatenate(prints)
        counts, keys = segment_counts(fp), []
        for n, groups in enumerate(chosen):
            mask = np.uint64(sum(((1 << width) - 1) << (width * int(g)) for g in groups))
            key = (counts & mask) * np.uint64(0x9E3779B97F4A7C15)
            keys.append((key ^ (key >> np.uint64(29)) ^ np.uint64(n * 0x632BE59BD9B4E019 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9))
        key, fp = np.concatenate(keys), np.tile(fp, len(chosen))
        bucket = ((key >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        parts = [p for p in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(p)]
        return pd.DataFrame({"bucket": [int(bucket[p[0]]) for p in parts], "data": [np.stack([key[p], fp[p]]).tobytes() for p in parts]})

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch["fp"].to_numpy(np.int64).view(np.uint64))
            n += len(batch)
            if n * len(chosen) >= HELD:
                yield filed(held)
                held, n = [], 0
        if n:
            yield filed(held)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        both = np.concatenate([np.frombuffer(d, dtype=np.uint64).reshape(2, -1) for d in pdf["data"]], axis=1)
        order = np.lexsort((both[1], both[0]))
        key, fp = both[0][order], both[1][order]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        out = []

        def join(pairs) -> None:
            for x, y in pairs:
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((x, y))

        sizes = np.diff(starts)
        for a, b in zip(starts[:-1][sizes > SMALL], starts[1:][sizes > SMALL]):
            join(_forest(fp[a:b], bits))
        # Small cells are compared all at once, each fingerprint with the one `by` places on.
        counts, end = segment_counts(fp), np.repeat(np.where(sizes > SMALL, 0, starts[1:]), sizes)
        at = np.arange(len(fp))
        for by in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
            at = at[at + by < end[at]]
            near = at[manhattan(counts[at], counts[at + by]) <= bits]
            near = near[np.bitwise_count(fp[near] ^ fp[near + by]) <= bits]
            join(zip(fp[near].tolist(), fp[near + by].tolist()))
        pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return prints.select("fp").mapInPandas(cells, "bucket int, data binary").repartition(buckets, "bucket").groupBy("bucket").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """Per row: id, fp and component, the smallest id that links reach from it."""
    bounded_batches(docs.sparkSession)
    prints = written(fingerprints(docs, id, text, shingle), "prints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(nodes.select("fp"), bits, blocks))
    named = nodes.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(named.join(smallest, "root").select("fp", "component"), "fp").select(F.col("id").alias(id), "fp", "component")


def _spanning(fp: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(distance, i, j): the shortest edges of at most `bits` bits that connect the fingerprints (rows of two words), one row at a time."""
    n = len(fp)
    best, by, left, at, out = np.full(n, 255, dtype=np.uint8), np.zeros(n, dtype=np.int64), np.arange(1, n), 0, []
    while len(left):
        d = np.bitwise_count(fp[left, 0] ^ fp[at, 0]) + np.bitwise_count(fp[left, 1] ^ fp[at, 1])
        closer = d < best[left]
        best[left[closer]], by[left[closer]] = d[closer], at
        k = int(best[left].argmin())
        at = int(left[k])
        if best[at] <= bits:
            out.append((int(best[at]), int(by[at]), at))
        left = np.delete(left, k)
    return out


def close(prints: DataFrame, bits: int, fixed: int, blocks: int, grids: list[int]) -> DataFrame:
    """(a1, a2, b1, b2): a forest of short edges between distinct pairs of fingerprints (columns f1, f2) that differ in at most `bits` of 128 bits.

    What shares the bit counts of `fixed` of the `blocks` groups of either fingerprint meets in a cell; `grids`: the numbers of the
    combinations to use.
    """
    width = 64 // blocks // 2 * 2
    masks = np.array([sum(((1 << width) - 1) << (width * g) for g in groups) for groups in combinations(range(blocks), fixed)], dtype=np.uint64)
    used = [side * len(masks) + g for side in (0, 1) for g in grids]
    prints = prints.select("f1", "f2").distinct()
    buckets = _buckets(prints, len(used), CLOSE_DEALT)

    def keys(fp: np.ndarray, grid: np.ndarray) -> np.ndarray:
        side = grid >= len(masks)
        key = (segment_counts(np.where(side, fp[:, 1], fp[:, 0])) & masks[grid % len(masks)]) * np.uint64(0x9E3779B97F4A7C15)
        return (key ^ (key >> np.uint64(29)) ^ (grid.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xBF58476D1CE4E5B9)

    def placed(fp: np.ndarray, grid: np.ndarray) -> np.ndarray:
        return ((keys(fp, grid) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)

    def filed(held: list[np.ndarray]) -> pd.DataFrame:
        """One row a bucket: the fingerprints in it, each with the number of the grid that put it there."""
        fp = np.concatenate(held)
        bucket = np.concatenate([placed(fp, np.full(len(fp), g)) for g in used])
        order, numbers = np.argsort(bucket, kind="stable"), np.array(used, dtype=np.uint16)
        parts = [p for p in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(p)]
        return pd.DataFrame({"bucket": [int(bucket[p[0]]) for p in parts], "grid": [numbers[p // len(fp)].tobytes() for p in parts], "data": [fp[p % len(fp)].tobytes() for p in parts]})

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch[["f1", "f2"]].to_numpy(np.int64).view(np.uint64))
            n += len(batch)
            if n * len(used) >= CLOSE_HELD:
                yield filed(held)
                held, n = [], 0
        if n:
            yield filed(held)

    def owner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The bucket of the first cell that both ends share, which alone takes the pair: every pair has one, so forests over each
        bucket's own pairs connect what all pairs would."""
        apart = segment_counts(a) ^ segment_counts(b)
        first = np.full(len(a), -1, dtype=np.int64)
        for g in used:
            first[(first < 0) & (apart[:, g // len(masks)] & masks[g % len(masks)] == 0)] = g
        return placed(a, first)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.concatenate([np.frombuffer(g, dtype=np.uint16) for g in pdf["grid"]]).astype(np.int64)
        fp = np.concatenate([np.frombuffer(d, dtype=np.uint64).reshape(-1, 2) for d in pdf["data"]])
        key = keys(fp, grid)
        order = np.lexsort((fp[:, 1], fp[:, 0], key))
        key, fp = key[order], np.ascontiguousarray(fp[order])
        starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        sizes = np.diff(starts)
        found = [np.array([(d, a + i, a + j) for d, i, j in _spanning(fp[a:b], bits)], dtype=np.int64).reshape(-1, 3) for a, b in zip(starts[:-1][sizes > SMALL], starts[1:][sizes > SMALL])]
        # Small cells are compared all at once, each fingerprint with the one `by` places on.
        end, at, (one, two) = np.repeat(np.where(sizes > SMALL, 0, starts[1:]), sizes), np.arange(len(fp)), np.ascontiguousarray(fp.T)
        for by in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
            at = at[at + by < end[at]]
            d = np.bitwise_count(one[at] ^ one[at + by]) + np.bitwise_count(two[at] ^ two[at + by])
            near = d <= bits
            found.append(np.stack([d[near].astype(np.int64), at[near], at[near] + by], axis=1))
        pairs = np.concatenate([np.zeros((0, 3), dtype=np.int64), *found])
        nodes, where = np.unique(fp[pairs[:, 1:].ravel()], axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack([pairs[:, 0], np.sort(where.reshape(-1, 2), axis=1)]), axis=0)
        root, out = list(range(len(nodes))), []
        for edge in pairs[owner(nodes[pairs[:, 1]], nodes[pairs[:, 2]]) == int(pdf["bucket"].iloc[0])].tolist():  # shortest first
            x, y = edge[1:]
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append(edge)
        ends = np.array(out, dtype=np.int64).reshape(-1, 3)
        return pd.DataFrame(np.concatenate([nodes[ends[:, 1]], nodes[ends[:, 2]]], axis=1).view(np.int64), columns=["a1", "a2", "b1", "b2"])

    filled = prints.mapInPandas(cells, "bucket int, grid binary, data binary").repartition(buckets, "bucket")
    return filled.groupBy("bucket").applyInPandas(search, "a1 long, a2 long, b1 long, b2 long")


def _often(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """Shingles that many texts have, the more frequent the later, at most `ORDERED` of them: they are only put last in an order."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [np.zeros(0, dtype=np.uint64)], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held += [np.unique(shingles(t, shingle)) for t in batch["text"]]
                n += sum(map(len, held[-len(batch) :])) if len(batch) else 0
            if n >= HELD or batch is None:
                found, times = np.unique(np.concatenate(held), return_counts=True)
                yield pd.DataFrame({"h": found[times > 1].view(np.int64), "n": times[times > 1]})
                held, n = [np.zeros(0, dtype=np.uint64)], 0

    some = docs.select(F.col(text).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(ORDERED_BY)) == 0)
    counts = some.mapInPandas(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    return np.sort(np.array([r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(ORDERED).collect()], dtype=np.int64).view(np.uint64))


def _allowed(least: float) -> Column:
    """Whether the sizes and parities of two sets (structs x and y) leave room for the share that is asked for."""
    apart = sum((F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) for k in range(PARITIES)), F.lit(0))
    x, y = F.col("x.n"), F.col("y.n")
    return (F.least(x, y) >= F.lit(least) * F.greatest(x, y) - 1e-6) & (apart <= F.lit((1 - least) / (1 + least)) * (x + y) + 1e-6)


def similar(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, bits: int = 30, fixed: int = 3, blocks: int = 10, only: DataFrame | None = None) -> DataFrame:
    """Per row: id and component, the smallest id that links between texts sharing at least `least` of their shingles reach from it.

    `only` (one column, named as `id`): rows with other ids, or none, take no part and are not returned; they go as sketches, so no text is shuffled for it."""
    bounded_batches(docs.sparkSession)
    often = _often(docs, text, shingle)
    numbers = ["set", "f1", "f2", "n", *(f"p{k}" for k in range(PARITIES))]

    @F.pandas_udf(f"struct<{','.join(f'{c}:bigint' for c in numbers)},keys:array<bigint>,long:array<bigint>>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        found, keys, long = np.zeros((len(texts), len(numbers)), dtype=np.uint64), [], []
        for k, t in enumerate(texts):
            h = np.unique(shingles(t, shingle))
            found[k, :3], found[k, 3], found[k, 4:] = sketch(h), len(h), parities(h)
            keys.append(prefix(h, least, often).view(np.int64))
            long.append(parities(h, LONG_PARITIES).view(np.int64) if len(h) > LONG else None)
        return pd.DataFrame(found.view(np.int64), columns=numbers).assign(keys=pd.Series(keys, dtype=object), long=pd.Series(long, dtype=object))

    @F.pandas_udf("array<bigint>")
    def shingled(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingles(t, shingle)).view(np.int64) for t in texts])

    whole = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    sketches = written(docs.select(F.col(id).alias("id"), whole.alias("whole"), sketched(F.col(text)).alias("s")).select("id", "whole", "s.*"), "sketches")
    rows = sketches.select("id", "whole", "set", "f1", "f2")
    if only is not None:
        rows = rows.join(only.select(F.col(id).alias("id")), "id", "left_semi")
    rows = written(rows, "rows")
    nodes = rows.groupBy("set").agg(F.min("id").alias("least"), F.min("whole").alias("whole"), F.min("f1").alias("f1"), F.min("f2").alias("f2"))
    nodes = written(nodes, "nodes")
    first = written(nodes.groupBy("f1", "f2").agg(F.min("set").alias("first")), "first")
    ends = [first.select(F.col("f1").alias(f"{e}1"), F.col("f2").alias(f"{e}2"), F.col("first").alias(e)) for e in "ab"]

    longs = written(sketches.filter("long is not null").select("set", "n", "long").dropDuplicates(["set"]), "longs")
    long_ends = [longs.select(F.col("set").alias(e), F.col("n").alias(f"n{e}"), F.col("long").alias(f"l{e}")) for e in "ab"]
    apart = F.aggregate(F.zip_with("la", "lb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)

    def linked(edges: DataFrame) -> DataFrame:
        """The (a, b) edges between sets of shingles that are as similar as asked."""
        edges = edges.join(long_ends[0], "a", "left").join(long_ends[1], "b", "left")
        edges = written(edges.filter(F.coalesce(apart <= F.lit((1 - least) / (1 + least)) * (F.col("na") + F.col("nb")) + 1e-6, F.lit(True))).select("a", "b"), "candidates")
        wanted = edges.select(F.col("a").alias("set")).union(edges.select("b")).distinct().join(nodes.select("set", "whole"), "set")
        texts = docs.select(whole.alias("whole"), F.col(text).alias("text")).join(wanted, "whole").groupBy("set").agg(F.first("text").alias("text"))
        sets = written(texts.select("set", shingled("text").alias("shingles")), "sets")
        both = edges.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        out = written(both.filter(common >= F.lit(least) * (F.size("x") + F.size("y") - common)).select("a", "b"), "linked")
        dropped(edges)
        dropped(sets)
        return out

    def pairs(edges: DataFrame) -> DataFrame:
        return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # One row of each set: its keys that another set has too, and of the sets of a key the one that all are held against first.
    one = nodes.select(F.col("set").alias("of"), "least")
    alone = sketches.join(one, (F.col("set") == F.col("of")) & F.col("id").eqNullSafe(F.col("least")))
    key = Window.partitionBy("key")
    filed = alone.select("set", F.explode("keys").alias("key"))
    filed = filed.select("key", "set", F.min("set").over(key).alias("lo"), F.max("set").over(key).alias("hi"), F.min(F.struct(F.xxhash64("set", "key"), "set")).over(key)["set"].alias("hub"))
    shared = written(filed.filter("lo <> hi").select("key", "set", "hub"), "shared")
    marks = sketches.select("set", F.struct(*numbers[3:]).alias("x")).join(shared.select("set").distinct(), "set", "left_semi").dropDuplicates(["set"])
    marks = written(marks, "marks")
    x, y = marks.select(F.col("set").alias("a"), "x"), marks.select(F.col("set").alias("b"), F.col("x").alias("y"))
    stars = pairs(shared.select(F.col("set").alias("a"), F.col("hub").alias("b"))).join(x, "a").join(y, "b").filter(_allowed(least)).select("a", "b")

    # Different sets with the same fingerprints are held against the first of them.
    equal = nodes.join(first, ["f1", "f2"]).filter("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b"))
    grids = [n for n, groups in enumerate(combinations(range(blocks), fixed)) if groups[0] % fixed == 0 and groups[-1] == groups[0] + fixed - 1]
    met = close(first, bits, fixed, blocks, grids).join(ends[0], ["a1", "a2"]).join(ends[1], ["b1", "b2"]).select("a", "b")
    dense = linked(pairs(met.unionByName(equal).unionByName(stars)))
    dropped(sketches)
    roots = components(dense)

    # What is left are pairs of a key that no links connect.
    rooted = shared.select("key", "set").distinct().join(roots.select(F.col("a").alias("set"), F.col("b").alias("root")), "set", "left").withColumn("root", F.coalesce("root", "set"))
    rooted = rooted.withColumns({"lo": F.min("root").over(key), "hi": F.max("root").over(key)}).filter("lo <> hi").select("key", "set", "root").join(marks, "set")
    rooted = written(rooted, "rooted")
    left, right = rooted.select("key", F.col("set").alias("a"), F.col("root").alias("ra"), "x"), rooted.select("key", F.col("set").alias("b"), F.col("root").alias("rb"), F.col("x").alias("y"))
    rest = left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _allowed(least)).select("a", "b").distinct()
    wide = linked(rest)
    for table in (shared, marks, rooted, longs):
        dropped(table)
    # What the first links connect are stars by now; `wide` connects stars.
    merged = components(roots.unionByName(wide))
    dropped(roots)
    named = nodes.join(merged.select(F.col("a").alias("set"), F.col("b").alias("root")), "set", "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    return rows.join(named.join(smallest, "root").select("set", "component"), "set").select(F.col("id").alias(id), "component")


def op2(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
