"""From raw documents to tokens: five stages, each a corpus operator over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, line_dedup, sentence_pieces, simhash, toxicity
from tessera.llm.common import tidy, unused, written

#: Near copies share at least `SIMILAR` of their shingles of five words, counted on the shingles themselves.
SHINGLE, BLOCKS, SIMILAR = 5, 10, 0.8


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~toxicity.held_out(F.col("doc_id")))
    score = unused(docs, "_score")
    return toxicity.score(docs, toxicity.learn(docs, labels), to=score).filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that came before go from the texts; every document stays, and a count of characters is kept right."""
    out = line_dedup.deduplicate(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; documents without an id all stay.

    A copy that has lost its lines is no copy of anything any more, so texts are compared twice: as the documents of these ids came in, and, of those
    that stay then, as they are in `docs`. A document goes if in either form a smaller id of `docs` is in its group.
    """
    tidy(spark)
    came = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def gone(texts: DataFrame, ids: DataFrame) -> DataFrame:
        groups = written(simhash.similar(texts, shingle=SHINGLE, least=SIMILAR, blocks=BLOCKS, only=ids).distinct(), "groups")
        first = groups.groupBy("component").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
        return written(groups.select("doc_id").distinct().join(first, "doc_id", "left_anti"), "gone")

    ids = written(docs.select("doc_id").filter("doc_id is not null").distinct(), "ids")
    copies = gone(came, ids)
    both = copies.unionByName(gone(docs, ids.join(copies, "doc_id", "left_anti")))
    return docs.join(both, "doc_id", "left_anti").select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontamination.hits(docs, bench).filter(F.size("found") > 0).select("id", "row").distinct()
    row = F.xxhash64(docs["doc_id"].cast("string"), docs["text"])
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["id"]) & (row == hit["row"]), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to it."""
    import public_tokenizers

    model = sentence_pieces.Model.read(public_tokenizers.path("piece_bpe_32k.model"))
    # The executors have run four stages by now, so their tasks remember fewer words.
    rows = sentence_pieces.encode(docs, model, back="decoded", kept=75_000)
    return rows.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        sentence_pieces.digest(F.col("ids")).alias("ids_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [("toxicity", clean), ("line dedup", lines), ("simhash near-dedup", near), ("benchmark decontamination", leaks), ("sentence pieces", tokens)]
#: SQL expresses neither the learned lexicon nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
