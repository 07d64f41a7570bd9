"""Toxicity scores against a plain search for every entry at every place."""

import math
import random
import unicodedata

from pyspark.sql import functions as F

from tessera.llm import toxicity


def plain_words(text):
    """Each character on its own: a look-alike or digit for its letter, else its base letters, else a space."""
    out = ""
    for char in (text or "").lower():
        known = {**toxicity.HOMOGLYPHS, **toxicity.DIGITS}.get(char)
        if known:
            out += known
            continue
        letters = [toxicity.HOMOGLYPHS.get(c, c) for c in unicodedata.normalize("NFKD", char).lower() if not unicodedata.combining(c)]
        letters = "".join(c for c in letters if c.isalpha())
        out += letters or ("" if unicodedata.category(char) in ("Mn", "Cf") else " ")
    return out.split()


def plain_score(model, text):
    words = plain_words(text)
    line = f" {' '.join(words)} "
    at = lambda term: [i for i in range(len(line)) if line.startswith(term, i)]
    spared = [(i, i + len(p)) for p in model.exceptions for i in at(p)]
    total = sum(w for term, w in model.weights.items() for i in at(term) if not any(a <= i and i + len(term) <= b for a, b in spared))
    feature = math.log1p(100 * total / max(len(words), 20)) if words else 0.0
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.intercept + model.slope * feature))))


def test_scores_by_plain_search(spark):
    model = toxicity.Model({" bad ": 3.0, " wors": 2.5, " worst ": 4.0, " awful ": 2.75, " ba": 0.5}, (" bad luck ", " the worst case "), 1.3, -4.0)
    r = random.Random(4)
    pieces = ["bad", "BAD", "b4d", "bаd", "bád", "luck", "worst", "w0rst", "worse", "the", "case", "awful", "aw​ful", "fine", "ba", "base", "日本", "...", "\n", "ﬀ", "ß"]
    texts = [None, "", " ", "bad", "bad luck", "bad bad luck", "the worst case worst", "b a d", "x" * 5000 + " bad " + "y" * 5000, "bad " * 3000]
    texts += [" ".join(r.choices(pieces, k=r.randint(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {x.doc_id: x.s for x in toxicity.score(docs, model, to="s").collect()}
    for i, text in enumerate(texts):
        assert abs(got[i] - plain_score(model, text)) < 1e-9, text
    assert toxicity.score(docs, toxicity.Model(), to="s").agg(F.max("s")).first()[0] < 1e-8


def test_op6_scores_by_plain_search(spark):
    """The learned model's score of every document."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic").filter(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.learn(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.op6(spark, d).collect():
        want = plain_score(model, text[r.doc_id])
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= toxicity.THRESHOLD)
