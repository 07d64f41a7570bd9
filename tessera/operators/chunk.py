"""Universal chunking: text by headings, configuration by its outermost keys, anything else by size alone."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_CHUNK = 2048
SCHEMA = "path string, ordinal int, kind string, name string, qualified string, start int, end int, parent int, part int"
_HEADING = re.compile(r"\s*(#{1,6})[ \t](.*)$", re.S)
_KEY = re.compile(r"""(\s*)(?:"([\w$./-]+)"|'([\w$./-]+)'|([\w$./-]+))\s*[:=]""")


def _lines(text: str) -> list[tuple[int, str]]:
    """(start in bytes, line with its end) of each line."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, line))
        at += len(line.encode()) + 1
    return out


def headings(text: str) -> list[tuple[int, str, str]]:
    """(start, title, trail) of the headings; the trail has the titles of the levels above."""
    out, trail = [], []
    for at, line in _lines(text):
        m = _HEADING.match(line)
        title = m[2].strip().rstrip("#").strip() if m else ""
        if title:
            trail = [t for t in trail if t[0] < len(m[1])] + [(len(m[1]), title)]
            out.append((at, title, "/".join(t[1] for t in trail)))
    return out


def config_keys(text: str) -> list[tuple[int, str, str]]:
    """(start, key, key) of the lines with a key at the least indent that any has; comments do not count."""
    found = [(at, len(m[1].encode()), m[2] or m[3] or m[4]) for at, line in _lines(text) if not line.lstrip().startswith(("#", ";")) and (m := _KEY.match(line))]
    least = min((indent for _, indent, _ in found), default=0)
    return [(at, key, key) for at, indent, key in found if indent == least]


def pieces(text: str, start: int, end: int, limit: int = MAX_CHUNK) -> list[tuple[int, int]]:
    """Byte ranges of at most `limit` bytes that end with lines; a longer line is one piece, blank pieces are dropped."""
    data, out, a, at = text.encode(), [], start, start
    while at < end:
        stop = data.find(b"\n", at, end)
        stop = end if stop < 0 else stop + 1
        if stop - a > limit and at > a:
            out.append((a, at))
            a = at
        at = stop
    out.append((a, end))
    return [(x, y) for x, y in out if data[x:y].strip()]


def chunks(text: str | None, kind: str, limit: int = MAX_CHUNK) -> list[tuple]:
    """(ordinal, kind, name, qualified, start, end, parent, part): the file first, then its sections in order.

    Text before the first section has no name. Each further piece with a name that was seen gets its number: `name#2`.
    """
    text = text or ""
    size = len(text.encode())
    marks = headings(text) if kind == "text" else config_keys(text) if kind == "config" else []
    sections = [(a, b, name, q) for (a, name, q), b in zip(marks, [m[0] for m in marks[1:]] + [size])]
    if not sections or sections[0][0] > 0:
        sections.insert(0, (0, sections[0][0] if sections else size, None, None))
    out, seen = [(0, "file", None, None, 0, size, None, 0)], Counter()
    for a, b, name, q in sections:
        for part, (x, y) in enumerate(pieces(text, a, b, limit)):
            seen[q] += 1
            label = q if q is None or seen[q] == 1 else f"{q}#{seen[q]}"
            out.append((len(out), f"{kind}_section" if kind in ("text", "config") else "chunk", name, label, x, y, 0, part))
    return out


def chunk(files: DataFrame, path: str = "path", text: str = "text", kind: str = "dialect", limit: int = MAX_CHUNK) -> DataFrame:
    """One row for each chunk of each file; greedy splitting is sequential within a file and independent between files."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *c) for p, t, k in zip(f["path"], f["text"], f["kind"]) for c in chunks(t, k, limit)]
            out = pd.DataFrame(rows, columns=["path", "ordinal", "kind", "name", "qualified", "start", "end", "parent", "part"])
            yield out.astype({"parent": "Int32"})

    return files.select(F.col(path).alias("path"), F.col(text).alias("text"), F.col(kind).alias("kind")).mapInPandas(cut, SCHEMA)


# ---- finishing units


class Enclosing:
    """Walks spans in order of (start, -end) and tells the smallest earlier one around each; only spans that are still open are held."""

    def __init__(self):
        self.open: list[tuple[int, int, int]] = []

    def __call__(self, start: int, end: int, index: int) -> int | None:
        self.open = [o for o in self.open if o[1] >= start]
        around = [(y - x, -j) for x, y, j in self.open if y >= end and (x, y) != (start, end)]
        self.open.append((start, end, index))
        return -min(around)[1] if around else None


def enclosing(spans: list[tuple[int, int]]) -> list[int | None]:
    """For each span the number of the smallest one around it; equal spans enclose nothing, of equally long ones the later counts."""
    walk, out = Enclosing(), [None] * len(spans)
    for i in sorted(range(len(spans)), key=lambda i: (spans[i][0], -spans[i][1], i)):
        out[i] = walk(*spans[i], i)
    return out


def parents(units: DataFrame, file: str = "path") -> DataFrame:
    """Each unit (index, start, end) with the index of the smallest unit that encloses it; equal spans enclose nothing, of equally
    long ones the later counts. Spark sorts the units of a file; a task walks them and holds the spans that are open."""
    ordered = units.repartition(F.col(file)).sortWithinPartitions(file, "start", F.desc("end"), "index")

    def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, walk = object(), Enclosing()
        for f in frames:
            found = []
            for p, a, b, i in zip(f[file], f["start"], f["end"], f["index"]):
                if p != who:
                    who, walk = p, Enclosing()
                found.append(walk(a, b, i))
            yield f.assign(parent=pd.array(found, dtype="Int64"))

    kind = dict(units.dtypes)["index"]
    schema = ", ".join(f"`{n}` {t}" for n, t in units.drop("parent").dtypes)
    return ordered.drop("parent").mapInPandas(walked, f"{schema}, parent {kind}")


def section_ends(marks: DataFrame, file: str = "path", start: str = "start", size: str = "size") -> DataFrame:
    """Each section's end: the start of the next one of its file, or the file's size."""
    following = F.lead(start).over(W.partitionBy(file).orderBy(start))
    return marks.withColumn("end", F.coalesce(following, F.col(size)))


def locator(pairs: Column) -> Column:
    """A map as `k=v;` in order of the keys; keys that look like paths are refused as null."""
    entries = F.sort_array(F.map_entries(pairs))
    bad = F.exists(entries, lambda e: e["key"].rlike(r"[/\\=;]"))
    return F.when(~bad, F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))), ""))


def parse_locator(text: Column) -> Column:
    return F.str_to_map(F.regexp_replace(text, ";$", ""), F.lit(";"), F.lit("="))


def fingerprint(pairs: Column) -> Column:
    """A map of versions as `k=v` in order of the keys, between semicolons."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(pairs)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def parser_fingerprint(**versions: str) -> str:
    return ";".join(f"{k}={v}" for k, v in sorted(versions.items()))
