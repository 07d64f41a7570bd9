"""Edit-aware token counts.

A document is split into pre-tokens, the pieces that byte-pair encoding never merges across, and their token counts are the
leaves (`leaf` pre-tokens each) of a sum tree. An edit re-encodes from the last pre-token boundary that it cannot have moved,
two characters of context before it, to the first boundary after it that the old split has too; from there on the old
split holds, as a pre-token depends only on what follows its start. The leaves touched and the sums above them are updated;
nothing else is encoded again. `plant_trees` makes the trees, columns to be stored with the texts; `edit_trees` takes stored trees
and edits and returns the texts and trees after them, so that later edits start from there. `count_tokens` does both at once.

Pre-tokens' counts are remembered by each task in a table of bounded size. The vocabulary is a file whose path is a parameter; the
driver reads it and sends its bytes, so executors need no such file.

Nulls and empty texts have no tokens. Edits are (start, end, replacement) in characters; they are applied in order of their start, are cut
to the text and to what earlier edits leave, those with a null start or end are left out, a null replacement is empty and a null list
means none. Very long texts and runs take time in proportion to their length. Rows that repeat are counted one by one. Empty tables
give empty results. Only the named columns are read.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import bounded_batches

LEAF = 32
CONTEXT = 3
LOOK_AHEAD = 64
REMEMBERED = 400_000
#: What the query edits out: mail addresses, which begin where a run of their characters does, and long digit runs.
PRIVATE = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[MAIL]"), (r"[0-9]{9,}", "[NUMBER]")


class Encoder:
    """Counts the tokens of pre-tokens with a byte-pair vocabulary of `token rank` lines."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import base64

        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("tessera", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.find = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def split(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ends and token counts of the pre-tokens."""
        pieces = self.find(text)
        get, known = self.count, self.known
        counts = [known[p] if p in known else get(p) for p in pieces]
        return np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))), np.array(counts, dtype=np.int64)


@dataclass
class Tree:
    """What is kept of a document: lengths and token counts of its pre-tokens, how many of them each leaf has, and the sums over the
    leaves, level by level up to the root."""

    lengths: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, lengths: np.ndarray, counts: np.ndarray, leaf: int = LEAF) -> Tree:
        at = np.arange(0, len(counts), leaf)
        levels = [np.add.reduceat(counts, at) if len(at) else np.zeros(1, dtype=np.int64)]
        while len(levels[-1]) > 1:
            levels.append(np.add.reduceat(levels[-1], np.arange(0, len(levels[-1]), 2)))
        return cls(lengths, counts, np.diff(np.append(at, len(counts))) if len(at) else np.zeros(1, dtype=np.int64), levels)

    def add(self, leaf: int, tokens: int, pretokens: int) -> None:
        self.sizes[leaf] += pretokens
        for level in self.levels:
            level[leaf] += tokens
            leaf //= 2

    @property
    def total(self) -> int:
        return int(self.levels[-1][0])

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        return tuple(a.astype(np.int32).tobytes() for a in (self.lengths, self.counts, self.sizes, np.concatenate(self.levels)))

    @classmethod
    def unpacked(cls, lengths: bytes, counts: bytes, sizes: bytes, sums: bytes) -> Tree:
        lengths, counts, sizes, sums = (np.frombuffer(b, np.int32).astype(np.int64) for b in (lengths, counts, sizes, sums))
        levels, at, n = [], 0, len(sizes)
        while True:
            levels.append(sums[at : at + n])
            at += n
            if n <= 1:
                return cls(lengths, counts, sizes, levels)
            n = (n + 1) // 2


def plant(text: str, encoder: Encoder, leaf: int = LEAF) -> Tree:
    ends, counts = encoder.split(text)
    return Tree.of(np.diff(ends, prepend=0), counts, leaf)


def orderly(text: str, edits) -> list[tuple[int, int, str]]:
    """Edits in order, within the text and apart; without those that have no start or end."""
    out, at = [], 0
    for a, b, new in sorted((a, b, new or "") for a, b, new in edits if a is not None and b is not None):
        a = min(max(a, at), len(text))
        b = min(max(b, a), len(text))
        out.append((a, b, new))
        at = b
    return out


def edited(text: str, tree: Tree, edits, encoder: Encoder, leaf: int = LEAF) -> tuple[str, Tree, int]:
    """The text after the edits, its tree, and how many pre-tokens were encoded for it. `tree` itself stays as it is."""
    edits, ends, counts = orderly(text, edits), np.cumsum(tree.lengths), tree.counts
    last_of = np.cumsum(tree.sizes)
    tree = Tree(tree.lengths, counts, tree.sizes.copy(), [level.copy() for level in tree.levels])
    lengths, kept, again, upto, k = [], [], 0, 0, 0
    while k < len(edits):
        first = edits[k][0]
        left = int(np.searchsorted(ends, first - CONTEXT, side="right"))  # pre-tokens that stay before the edit
        left = max(left, upto)
        start = int(ends[left - 1]) if left else 0
        group, done, reach = [edits[k]], False, LOOK_AHEAD
        k += 1
        while not done:
            stop = min(len(text), group[-1][1] + reach)
            while k < len(edits) and edits[k][0] - CONTEXT <= stop:  # an edit within the context joins in
                group.append(edits[k])
                k += 1
                stop = min(len(text), group[-1][1] + reach)
            pieces, at = [], start
            for a, b, new in group:
                pieces += [text[at:a], new]
                at = b
            fresh = "".join(pieces)
            changed, snippet = len(fresh), fresh + text[at:stop]
            new_ends, new_counts = encoder.split(snippet)
            last = len(snippet) if stop == len(text) else len(snippet) - CONTEXT
            right = len(counts)
            n = len(new_ends)
            for i in np.flatnonzero((new_ends >= changed) & (new_ends <= last)):
                old = at + int(new_ends[i]) - changed
                j = int(np.searchsorted(ends, old)) if old else -1  # the text's start is a boundary too
                if j < 0 or (j < len(ends) and ends[j] == old):
                    right, n, done = j + 1, int(i) + 1, True
                    break
            if stop == len(text):
                done = True
            reach *= 4
        touched = int(np.searchsorted(last_of, left, side="right"))
        into = min(touched, len(tree.sizes) - 1)
        for at_leaf in range(touched, min(int(np.searchsorted(last_of, max(left, right - 1), side="right")), len(tree.sizes) - 1) + 1):
            low = int(last_of[at_leaf - 1]) if at_leaf else 0
            lost = counts[max(left, low) : min(right, int(last_of[at_leaf]))]
            tree.add(at_leaf, -int(lost.sum()), -len(lost))
        tree.add(into, int(new_counts[:n].sum()), n)
        lengths += [tree.lengths[upto:left], np.diff(new_ends[:n], prepend=0)]
        kept += [counts[upto:left], new_counts[:n]]
        again += n
        upto = right
    tree.lengths, tree.counts = np.concatenate([*lengths, tree.lengths[upto:]]), np.concatenate([*kept, counts[upto:]])
    out, at = [], 0
    for a, b, new in edits:
        out += [text[at:a], new]
        at = b
    if tree.sizes.max(initial=0) > 8 * leaf:  # a leaf has grown by insertions: the same counts under new leaves
        tree = Tree.of(tree.lengths, tree.counts, leaf)
    return "".join([*out, text[at:]]), tree, again


def private_edits(text: str) -> list[tuple[int, int, str]]:
    import re

    found = sorted((m.start(), m.end(), new) for pattern, new in PRIVATE for m in re.finditer(pattern, text))
    out = []
    for a, b, new in found:
        if not out or a >= out[-1][1]:
            out.append((a, b, new))
    return out


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, id: str = "doc_id", text: str = "text", edits: str | None = None, rule=private_edits, leaf: int = LEAF) -> DataFrame:
    """Per row: id, n_tokens, n_tokens_edited, n_edits, n_pretokens, n_encoded_again.

    `edits` names a column of (start, end, replacement) structs; without it, `rule` makes the edits from the text.
    """

    def counted(encoder: Encoder, row) -> tuple:
        t = row.text or ""
        given = rule(t) if edits is None else _given(row.edits)
        tree = plant(t, encoder, leaf)
        _, after, again = edited(t, tree, given, encoder, leaf)
        return row.id, tree.total, after.total, len(orderly(t, given)), len(tree.counts), again

    names = [id, "n_tokens", "n_tokens_edited", "n_edits", "n_pretokens", "n_encoded_again"]
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), *([F.col(edits).alias("edits")] if edits else []))
    return _mapped(rows, vocabulary, pattern, counted, names, [dict(docs.dtypes)[id]] + ["long"] * 5)


def _given(edits) -> list[tuple]:
    return [(e["start"], e["end"], e["replacement"]) for e in (edits if edits is not None else []) if e is not None]


def _mapped(rows: DataFrame, vocabulary: str, pattern: str, one, names: list[str], kinds: list[str]) -> DataFrame:
    """Applies `one` (encoder, row) to each row; a task has one encoder and holds one batch of texts."""
    bounded_batches(rows.sparkSession)
    with open(vocabulary, "rb") as f:
        ranks = rows.sparkSession.sparkContext.broadcast(f.read())

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            found = [one(encoder, Row(*values)) for values in zip(*columns)]
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], kind) for c, kind in enumerate(arrow)], names)

    schema = T.DataType.fromDDL(", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
    arrow, Row = [f.type for f in to_arrow_schema(schema)], namedtuple("Row", rows.columns)
    return rows.mapInArrow(mapped, schema)


TREE = ["lengths", "counts", "sizes", "sums"]


def plant_trees(docs: DataFrame, vocabulary: str, pattern: str, id: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """Per row: id, text, n_tokens and the tree (lengths, counts, sizes, sums), to be stored for later edits."""

    def planted(encoder: Encoder, row) -> tuple:
        tree = plant(row.text or "", encoder, leaf)
        return row.id, row.text, tree.total, *tree.packed()

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return _mapped(rows, vocabulary, pattern, planted, [id, text, "n_tokens", *TREE], [dict(docs.dtypes)[id], "string", "long"] + ["binary"] * 4)


def edit_trees(trees: DataFrame, vocabulary: str, pattern: str, edits: str, id: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """What `plant_trees` or this function returned, with a column of edits, after the edits: the same columns and n_encoded_again.

    Text outside the edits' surroundings is neither split nor encoded.
    """

    def grown(encoder: Encoder, row) -> tuple:
        t, tree, again = edited(row.text or "", Tree.unpacked(row.lengths, row.counts, row.sizes, row.sums), _given(row.edits), encoder, leaf)
        return row.id, None if row.text is None and not t else t, tree.total, *tree.packed(), again

    rows = trees.select(F.col(id).alias("id"), F.col(text).alias("text"), *TREE, F.col(edits).alias("edits"))
    return _mapped(rows, vocabulary, pattern, grown, [id, text, "n_tokens", *TREE, "n_encoded_again"], [dict(trees.dtypes)[id], "string", "long"] + ["binary"] * 4 + ["long"])


def op3(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
