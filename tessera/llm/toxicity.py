"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded text.

Folding lower-cases, strips accents, replaces homoglyphs of other alphabets and digits or signs that stand for letters, and
turns everything else into spaces, so `1D10T` and a Cyrillic look-alike meet the same entry. The lexicon is learned from labelled
rows: whole words and word beginnings whose document frequency is much higher in toxic rows, weighted by their log odds.
Exception phrases are pairs of neighbouring words around an entry that labelled rows show to be harmless; an entry inside
one does not count. The weights of the entries found are summed, divided by the text's length in words, and a one-variable
logistic curve turns the result into a score between 0 and 1.

At most `fit_rows` labelled rows, chosen by a hash of their id, are learned from (a documented bound of the classifier alone);
every row is scored whole. The lexicon has at most `max_terms` entries, which bounds the model that tasks carry.

Nulls and empty texts have no entries and get the curve's lowest score. Rows that repeat are scored one by one. Labels without
a document, documents without a label and null labels teach nothing; without any labelled row of both kinds the lexicon
is empty and every score is the rate of toxic rows seen (0 if none). Empty tables give empty results. Only the named
columns are read.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

FIT_ROWS = 40_000
SLICE, HELD = 50_000, 400_000
MAX_TERMS = 2_000
THRESHOLD = 0.7
#: Letters of other alphabets that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "s",
}
#: Digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "+": "t"}
PREFIX = range(4, 9)


class _Fold(dict):
    """Filled as characters come up: a letter's base letter, or a space."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        base = HOMOGLYPHS.get(char) or DIGITS.get(char)
        if base is None:
            parts = [c for c in unicodedata.normalize("NFKD", char).lower() if not unicodedata.combining(c)]
            parts = [HOMOGLYPHS.get(c, c) for c in parts]
            base = "".join(c for c in parts if c.isalpha()) or ("" if unicodedata.category(char) in ("Mn", "Cf") else " ")
        self[code] = base
        return base


_FOLD = _Fold()


def fold(text: str | None) -> list[str]:
    """The folded words of a text."""
    return (text or "").lower().translate(_FOLD).split()


def candidates(words: list[str]) -> set[str]:
    """What could be an entry: ` word ` and, for longer words, ` begin`."""
    seen = set()
    for w in set(words):
        if 3 <= len(w) <= 40:
            seen.add(f" {w} ")
            seen.update(f" {w[:k]}" for k in PREFIX if k < len(w))
    return seen


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    intercept: float = -20.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, w in self.weights.items():
            found.add_word(term, (len(term), w, term))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None, phrase))
        if len(found):
            found.make_automaton()
        return found

    def feature(self, words: list[str], automaton) -> float:
        """Weights of the entries outside exception phrases, for each word of the text, on a logarithmic scale."""
        if not words or not len(automaton):
            return 0.0
        hits, spared = [], []
        for end, (n, w, _) in automaton.iter(f" {' '.join(words)} "):
            (spared if w is None else hits).append((end - n + 1, end, w))
        if spared:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in spared)]
        return math.log1p(100 * sum(h[2] for h in hits) / max(len(words), 20))

    def score(self, feature: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * feature))))


def choose(counts: pd.DataFrame, positive: int, negative: int, max_terms: int = MAX_TERMS) -> dict[str, float]:
    """The lexicon from (term, toxic, clean) document counts."""
    if not positive or not negative or counts.empty:
        return {}
    c = counts[(counts.toxic >= max(3, 0.004 * positive))].copy()
    c["w"] = np.log((c.toxic + 0.5) / (positive + 1)) - np.log((c.clean + 0.5) / (negative + 1))
    c = c[c.w >= 2.5].sort_values(["toxic", "term"], ascending=[False, True])
    have = dict(zip(c.term, c.toxic))
    # A beginning that one longer entry accounts for gives way to it; an entry that a shorter one covers as well is dropped.
    longer: Counter = Counter()
    for term, n in have.items():
        for k in PREFIX:
            if k < len(term) - 1:
                longer[term[: k + 1]] = max(longer[term[: k + 1]], n)
    kept: dict[str, float] = {}
    for term, w in sorted(zip(c.term, c.w), key=lambda x: (len(x[0].strip()), x[0])):
        if not term.endswith(" ") and longer[term] >= 0.95 * have[term]:
            continue
        if any(kept.get(term[: k + 1], -9) >= w - 1 for k in PREFIX if k < len(term.strip()) + 1 and term[: k + 1] != term):
            continue
        kept[term] = float(w)
    return dict(sorted(kept.items(), key=lambda x: (-have[x[0]], x[0]))[:max_terms])


def curve(features: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through weighted points, by Newton's method with a small ridge."""
    if not len(labels) or labels.min() == labels.max():
        rate = labels[0] if len(labels) else 0.0
        return 0.0, math.log((rate + 1e-9) / (1 - rate + 1e-9))
    x = np.column_stack([features, np.ones(len(features))])
    b, ridge = np.zeros(2), np.diag([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weights * (labels - p)) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def _candidate_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Document counts of candidates, split by label, and the rows of each kind under an empty term; sent on whenever `HELD` terms
    have come together, to be summed later."""
    counts = {0: Counter(), 1: Counter()}

    def sent() -> Iterator[pd.DataFrame]:
        terms = sorted(counts[1].keys() | counts[0].keys())
        for at in range(0, len(terms), SLICE):
            part = terms[at : at + SLICE]
            yield pd.DataFrame({"term": part, "toxic": [counts[1][t] for t in part], "clean": [counts[0][t] for t in part]})
        counts[0].clear()
        counts[1].clear()

    for batch in batches:
        for text, label in zip(batch["text"], batch["label"]):
            counts[label][""] += 1
            counts[label].update(candidates(fold(text)))
            if len(counts[0]) + len(counts[1]) > HELD:
                yield from sent()
    yield from sent()


def _pairs(words: list[str], terms: set[str]) -> set[str]:
    marked = [f" {w} " in terms or any(f" {w[:k]}" in terms for k in PREFIX) for w in words]
    return {f" {a} {b} " for a, b, x, y in zip(words, words[1:], marked, marked[1:]) if x or y}


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS, max_terms: int = MAX_TERMS) -> Model:
    """Fits lexicon, exception phrases and curve. `labels` holds the rows that may be learned from."""
    bounded_batches(docs.sparkSession)
    chosen = (
        labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    )
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("text", "label")
    counts = rows.mapInPandas(_candidate_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = counts.filter(F.col("term") == "").first()
    positive, negative = (total["toxic"], total["clean"]) if total else (0, 0)
    frequent = counts.filter((F.col("term") != "") & (F.col("toxic") >= max(3, 0.004 * positive)) & (F.col("toxic") > 8 * F.col("clean") * positive / max(1, negative)))
    weights = choose(frequent.toPandas(), positive, negative, max_terms)
    terms, model = set(weights), Model(weights)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(p, int(y)) for t, y in zip(batch["text"], batch["label"]) for p in sorted(_pairs(fold(t), terms))]
            yield pd.DataFrame(out, columns=["phrase", "label"])

    if weights:
        harmless = (
            rows.mapInPandas(found, "phrase string, label int").groupBy("phrase")
            .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
            .filter((F.col("clean") >= 5) & (F.col("toxic") * 20 <= F.col("clean")))
            .orderBy(F.desc("clean"), "phrase").limit(max_terms)
        )
        model.exceptions = tuple(sorted(r[0] for r in harmless.collect()))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.automaton()
        for batch in batches:
            yield pd.DataFrame({"x": [model.feature(fold(t), automaton) for t in batch["text"]], "y": batch["label"].astype("int32")})

    # Repeated ids could multiply the rows, so the curve takes them as counted groups of equal features, a few thousand at most.
    seen = rows.mapInPandas(features, "x double, y int").groupBy(F.round("x", 3).alias("x"), "y").count().toPandas().sort_values(["x", "y"])
    model.slope, model.intercept = curve(seen["x"].to_numpy(float), seen["y"].to_numpy(float), seen["count"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """All columns of `docs` and the score; a column that has its name is replaced."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = model.automaton()
        for texts in batches:
            yield pd.Series([model.score(model.feature(fold(t), automaton)) for t in texts], dtype="float64")

    return docs.withColumn(to, scored(F.col(text)))


def held_out(id):
    """The rows that no label is learned from."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op6(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    return score(docs, learn(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
