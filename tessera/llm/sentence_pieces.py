"""SentencePiece encoding and decoding.

A model file holds pieces with scores. A text becomes `▁`-escaped and falls into words, runs of `▁` with what follows; the model is
checked for pieces that would reach over a word's border, so words are encoded independently. Words are encoded by a relational
lattice: all substrings up to the longest piece are exploded, joined to the piece table, grouped by word and folded by Spark's
higher-order aggregate: for unigram models a Viterbi pass over the edges, for BPE models the merges in order of their score, as
a Viterbi pass over a BPE model's ranks would give other pieces than the model's own. What no piece covers becomes bytes.

The relational lattice encodes the `frequent` most frequent words of the corpus (a fixed bound on what is broadcast, and which
words they are does not change the result); the words outside it, each rare, meet the same rule in the task that reads them, since
joining every occurrence of them would shuffle more than the texts themselves.

Nulls and empty texts have no tokens and decode to the empty text. Words have no length limit. A `▁` in a text reads as a space, as
in the model's own format. Rows that repeat are encoded one by one. Empty tables give empty results. Only named columns are read.
"""

from __future__ import annotations

import heapq
import struct
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded_batches

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
WORD = r"▁*[^▁\n]+|\n|▁+"
FREQUENT, REMEMBERED, SEEN, SLICE = 200_000, 150_000, 3, 256
#: Words outside the frequent ones whose ids a task remembers, twice over; fewer take less of a task's room and more of its time.
KEPT = 150_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value: object = number()
        elif kind == 2:
            n = number()
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


@dataclass
class Model:
    """The pieces of a model: (text, score, type) by id."""

    pieces: list[tuple[str, float, int]]
    kind: int = BPE
    dummy_prefix: bool = True
    trim: bool = False

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            data = f.read()
        pieces, kind, prefix, trim = [], UNIGRAM, True, True
        for field, value in _fields(data):
            if field == 1:
                piece, score, of = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        of = v
                pieces.append((piece, score, of))
            elif field == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                prefix, trim = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
        return cls(pieces, kind, prefix, trim).checked()

    def checked(self) -> Model:
        for piece, _, of in self.pieces:
            if of in (NORMAL, USER) and (SPACE in piece.lstrip(SPACE) or ("\n" in piece and piece != "\n")):
                raise ValueError(f"a piece reaches over the border of a word: {piece!r}")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return self

    @property
    def table(self) -> dict[str, tuple[int, float]]:
        return {p: (i, s) for i, (p, s, of) in enumerate(self.pieces) if of in (NORMAL, USER)}

    @property
    def bytes_ids(self) -> list[int]:
        """The id of each byte's piece, or the unknown piece's where a model has none."""
        unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        found = {p: i for i, (p, _, of) in enumerate(self.pieces) if of == BYTE}
        return [found.get(f"<0x{b:02X}>", unknown) for b in range(256)]

    @property
    def floor(self) -> float:
        """The score of a character that is no piece, for unigram models."""
        return min((s for _, s, of in self.pieces if of == NORMAL), default=0.0) - 10

    def escaped(self, text: str | None) -> str:
        text = text or ""
        if self.trim:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return ((SPACE if self.dummy_prefix else "") + text).replace(" ", SPACE)

    def plain(self) -> list[bytes]:
        """What each id decodes to."""
        return [bytes([int(p[3:5], 16)]) if of == BYTE else b"" if of in (CONTROL, UNKNOWN) else p.replace(SPACE, " ").encode() for p, _, of in self.pieces]


class Rule:
    """Encodes single words; the relational fold gives the same ids."""

    def __init__(self, model: Model):
        self.table, self.bytes_ids, self.kind, self.floor = model.table, model.bytes_ids, model.kind, model.floor
        self.longest = max(map(len, self.table), default=1)
        self.scores = {p: s for p, (_, s) in self.table.items()}

    def ids(self, word: str) -> list[int]:
        out = []
        for part in self.merged(word) if self.kind == BPE else self.viterbi(word):
            hit = self.table.get(part)
            out += [hit[0]] if hit else [self.bytes_ids[b] for b in part.encode()]
        return out

    def merged(self, word: str) -> list[str]:
        """Adjacent parts are merged, the best score first and the leftmost of equal ones."""
        parts, get = list(word), self.scores.get
        if len(parts) > 200:
            return self._merged_long(parts)
        none = float("-inf")
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        n, get = len(parts), self.scores.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, parts[i] + parts[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if after[i] != j or not parts[j] or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p]

    def viterbi(self, word: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)] + [(float("-inf"), 0)] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                s = self.scores.get(word[start:end])
                if s is None and end - start == 1:
                    s = self.floor
                if s is not None and best[start][0] + s > best[end][0]:
                    best[end] = (best[start][0] + s, start)
        out, end = [], len(word)
        while end:
            out.append(word[best[end][1] : end])
            end = best[end][1]
        return out[::-1]


def _fold_merges(edges: Column, n: Column) -> Column:
    """The borders that are left when no two neighbouring parts make a piece."""

    def step(borders: Column, _: Column) -> Column:
        at = lambda e: F.array_position(borders, e["start"]).cast("int")
        fits = F.filter(edges, lambda e: (at(e) > 0) & F.coalesce(F.get(borders, at(e) + 1) == e["end"], F.lit(False)))
        best = F.array_max(F.transform(fits, lambda e: F.struct(e["score"].alias("s"), (-e["start"]).alias("first"), F.get(borders, at(e)).alias("mid"))))
        return F.when(best.isNull(), borders).otherwise(F.array_remove(borders, best["mid"]))

    start = F.sequence(F.lit(0), n)
    return F.when(n < 2, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step))


def _fold_viterbi(edges: Column, n: Column, floor: float) -> Column:
    """The borders of the best path; edges come in order of their end, then start."""
    state = "array<struct<score:double,back:int>>"
    single = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i + 1).cast("int").alias("end"), i.cast("int").alias("start"), F.lit(floor).alias("score"), F.lit(-1).alias("id")))
    missing = F.filter(single, lambda x: ~F.exists(edges, lambda e: (e["start"] == x["start"]) & (e["end"] == x["end"])))
    every = F.sort_array(F.concat(edges, missing))
    begin = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i == 0, 0.0).otherwise(F.lit(float("-inf"))).alias("score"), F.lit(0).alias("back"))).cast(state)

    def step(best: Column, e: Column) -> Column:
        reached = F.get(best, e["start"])["score"] + e["score"]
        return F.transform(best, lambda x, i: F.when((i == e["end"]) & (reached > x["score"]), F.struct(reached.alias("score"), e["start"].alias("back"))).otherwise(x)).cast(state)

    best = F.aggregate(every, begin, step)
    walk = F.aggregate(F.sequence(F.lit(1), n), F.array(n), lambda path, _: F.when(F.get(path, F.lit(0)) == 0, path).otherwise(F.concat(F.array(F.get(best, F.get(path, F.lit(0)))["back"]), path)))
    return walk


def encode_words(words: DataFrame, model: Model, word: str = "word") -> DataFrame:
    """(word, ids) of the distinct words in `words`, which must not be empty ones."""
    spark = words.sparkSession
    rows = [(p, i, float(s)) for p, (i, s) in model.table.items()]
    pieces = F.broadcast(spark.createDataFrame(rows, "piece string, id int, score double"))  # the vocabulary: a fixed size
    longest = max((len(r[0]) for r in rows), default=1)
    w = words.select(F.col(word).alias("word")).distinct().withColumn("n", F.length("word"))
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda a: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - a)), lambda k: F.struct(a.cast("int").alias("start"), k.cast("int").alias("k")))))
    edges = (
        w.select("word", F.explode_outer(spans).alias("s"))
        .select("word", F.col("s.start").alias("start"), (F.col("s.start") + F.col("s.k")).alias("end"), F.col("word").substr(F.col("s.start") + 1, F.col("s.k")).alias("piece"))
        .join(pieces, "piece")
        .groupBy("word").agg(F.sort_array(F.collect_list(F.struct("end", "start", "score", "id"))).alias("edges"))
    )
    empty = F.array().cast("array<struct<end:int,start:int,score:double,id:int>>")
    w = w.join(edges, "word", "left").withColumn("edges", F.coalesce("edges", empty))
    borders = _fold_merges(F.col("edges"), F.col("n")) if model.kind == BPE else _fold_viterbi(F.col("edges"), F.col("n"), model.floor)
    w = w.withColumn("borders", borders)
    by_byte = F.array(*[F.lit(i) for i in model.bytes_ids])

    def of(a: Column, i: Column) -> Column:
        b = F.get("borders", i + 1)
        hit = F.get(F.filter("edges", lambda e: (e["start"] == a) & (e["end"] == b)), F.lit(0))["id"]
        raw = F.hex(F.encode(F.col("word").substr(a + 1, b - a), "UTF-8"))
        one = F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda j: F.get(by_byte, F.conv(F.substr(raw, j, F.lit(2)), 16, 10).cast("int")))
        return F.when(hit.isNotNull(), F.array(hit)).otherwise(one)

    return w.select("word", F.flatten(F.transform(F.slice("borders", 1, F.size("borders") - 1), of)).alias("ids"))


def frequent_words(docs: DataFrame, model: Model, text: str = "text", most: int = FREQUENT, seen: int = SEEN) -> DataFrame:
    """The words seen most often, of those that some stretch of rows holds `seen` times."""

    def counting(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        find, counts = re.compile(WORD).findall, Counter()

        def sent() -> pd.DataFrame:
            kept = [(w, n) for w, n in counts.items() if n >= seen and len(w) <= 64]
            counts.clear()
            return pd.DataFrame(kept, columns=["word", "n"])

        for frame in frames:
            for t in frame["text"]:
                counts.update(find(model.escaped(t)))
                if len(counts) > REMEMBERED:
                    yield sent()
        yield sent()

    counts = docs.select(F.col(text).alias("text")).mapInPandas(counting, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).select("word")


def encode(docs: DataFrame, model: Model, text: str = "text", to: str = "ids", most: int = FREQUENT, back: str | None = None, kept: int = KEPT) -> DataFrame:
    """`docs` and the ids of each row's text; with `back`, also what they decode to, under that name.

    Rows pass through in slices of `SLICE`, so that a task holds the ids of few texts at a time. Columns that `docs` has under the new
    names are replaced.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in (to, back) if c])
    words = encode_words(frequent_words(docs, model, text, most), model)
    known = words.select("word", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids")).toPandas()  # at most `most` short words
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({w: array("i", map(int, ids.split())).tobytes() for w, ids in zip(known["word"], known["ids"])})

    def encoded(batches):
        import re

        import pyarrow as pa

        find, rule, frequent, decoder = re.compile(WORD).findall, Rule(model), shared.value, Decoder(model)
        rare: dict[str, bytes] = {}
        before: dict[str, bytes] = {}  # what was remembered before `rare` was last full

        def seldom(w: str) -> bytes:
            nonlocal rare, before
            ids = before.get(w)
            if ids is None:
                ids = array("i", rule.ids(w)).tobytes()
            if len(w) <= 64:
                if len(rare) >= kept:
                    rare, before = {}, rare
                rare[w] = ids
            return ids

        def ids_of(t: str | None) -> np.ndarray:
            parts = [frequent.get(w) or rare.get(w) or seldom(w) for w in find(model.escaped(t))]
            return np.frombuffer(b"".join(parts), dtype=np.int32)

        for batch in batches:
            column = batch.schema.get_field_index(text)
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [ids_of(t) for t in part.column(column).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                arrays = [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found), pa.int32()))]
                names = [*part.schema.names, to]
                if back:
                    arrays.append(pa.array([decoder.text(x) for x in found], pa.string()))
                    names.append(back)
                yield pa.RecordBatch.from_arrays(arrays, names)

    more = [T.StructField(to, T.ArrayType(T.IntegerType()))] + ([T.StructField(back, T.StringType())] if back else [])
    return docs.mapInArrow(encoded, T.StructType([*docs.schema.fields, *more]))


class Decoder:
    def __init__(self, model: Model):
        self.plain, self.cut = np.array([*model.plain(), b""], dtype=object), model.dummy_prefix

    def text(self, ids) -> str | None:
        if ids is None:
            return None
        n = len(self.plain) - 1
        if getattr(ids, "dtype", None) != np.int32:
            ids = np.array([n if i is None or i != i else int(i) for i in ids], dtype=np.int64)
        raw = b"".join(self.plain[np.where((ids >= 0) & (ids < n), ids, n)].tolist())
        return (raw[1:] if self.cut and raw[:1] == b" " else raw).decode("utf-8", "replace")


def decode(rows: DataFrame, model: Model, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """`rows` and the text of each row's ids; null ids give null, null or unknown single ids nothing."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(model)
        for given in batches:
            yield pd.Series([decoder.text(x) for x in given], dtype=object)

    return rows.withColumn(to, decoded(F.col(ids)))


def digest(ids: Column) -> Column:
    """SHA-256 of the ids, written in decimal with spaces."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = Model.read(public_tokenizers.path("piece_bpe_32k.model"))
    rows = encode(docs, model, back="decoded")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
