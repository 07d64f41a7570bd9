"""URL filters: fixed host and path rules first, and association rules mined by FP-growth for the rest.

A url becomes a set of tokens (scheme, each part of the host, path segments that are no numbers, names of query fields).
Labelled urls are transactions of their tokens and one class item; FP-growth finds frequent combinations, and rules with the
class as consequent are pruned by support, confidence and by shorter rules that are as sure. To match, each rule is filed in an
inverted index under its rarest token alone; a url looks up its tokens, checks the remaining tokens of the rules it finds,
and takes the verdict of the surest rule (confidence, support, then the tokens in order). No rule: allow.

The rules are counted before they are broadcast; beyond `broadcast_rules` the index is joined by shuffling.

Nulls, urls without `://` and empty tables: host and path are empty, no fixed rule fits, the verdict is allow. Rows that
repeat are judged one by one. Null labels teach nothing. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SUPPORT, CONFIDENCE, BROADCAST_RULES = 0.004, 0.6, 50_000
#: A rule rests on at least so many labelled urls, and is proven on a quarter as many that it wasn't mined from.
LEAST = 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(says)).otherwise(verdict)
    return found, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a url, in order."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    named = lambda name, parts: F.transform(parts, lambda x: F.concat(F.lit(f"{name}:"), x))
    some = lambda parts: F.filter(parts, lambda x: (x != "") & ~x.rlike(r"^[0-9]+(\.html?)?$"))
    return F.array_sort(
        F.array_distinct(
            F.concat(
                named("scheme", some(F.array(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z]+)://", 1)))),
                named("host", some(F.split(host, r"\."))),
                named("path", some(F.split(path, "/"))),
                named("query", some(F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0]))),
            )
        )
    )


def mine(urls: DataFrame, url: str = "url", bad: str = "bad", support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """(tokens, verdict, confidence, support) from labelled urls (`bad`: 1 block, 0 allow).

    A third of the urls, by a hash, is held out. A rule is mined from the rest, where at least `least` urls with its verdict hold it, and
    stays only if it is as sure on the urls held out, of which a quarter of `least` must hold it.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = urls.sparkSession
    named = F.when(F.col(bad) == 1, F.lit("=block")).otherwise(F.lit("=allow"))
    labelled = urls.filter(F.col(bad).isin(0, 1)).select(F.col(url).alias("url"), F.col(bad).alias("bad"), named.alias("class"))
    held_out = F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % 3 == 1
    baskets = labelled.filter(~held_out).select(F.concat(tokens(F.col("url")), F.array("class")).alias("items")).persist()
    n = baskets.count()
    if n < least:
        return spark.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=max(support, least / n), minConfidence=confidence, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(baskets)
    rules = model.associationRules.filter(F.element_at("consequent", 1) == "=block").select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), 2, 10).alias("verdict"), "confidence", "support"
    )
    # A rule is redundant if dropping one token leaves a rule that is as sure.
    parts = rules.withColumn("row", F.array_join("tokens", "\n"))
    shorter = parts.select("row", "confidence", F.explode_outer(F.transform("tokens", lambda t: F.array_join(F.array_remove("tokens", t), "\n"))).alias("less"))
    sure = parts.select(F.col("row").alias("less"), F.col("confidence").alias("less_confidence"))
    beaten = shorter.join(sure, "less").filter(F.col("less_confidence") >= F.col("confidence")).select("row").distinct()
    return proven(parts.join(beaten, "row", "left_anti").drop("row"), labelled.filter(held_out), "url", "bad", confidence, -(-least // 4))


def proven(rules: DataFrame, urls: DataFrame, url: str, bad: str, confidence: float, least: int) -> DataFrame:
    """The block rules that hold for at least `least` of the labelled urls and are right for the share `confidence` of them."""
    rows = urls.select(F.col(bad).alias("bad"), tokens(F.col(url)).alias("have"))
    hits = (
        rows.select("bad", "have", F.explode_outer("have").alias("token")).join(index(rules, urls, url), "token")
        .filter(F.size(F.array_except("tokens", "have")) == 0)
        .groupBy("tokens").agg(F.count("*").alias("n"), F.avg("bad").alias("right"))
    )
    return rules.join(hits.filter((F.col("n") >= least) & (F.col("right") >= confidence)).select("tokens"), "tokens", "left_semi")


def index(rules: DataFrame, urls: DataFrame, url: str = "url") -> DataFrame:
    """The rules under their rarest token in `urls`: (token, rest, verdict, confidence, support)."""
    used = rules.select(F.explode_outer("tokens").alias("token")).distinct()
    seen = urls.select(F.explode_outer(tokens(F.col(url))).alias("token")).groupBy("token").count().join(used, "token")
    place = rules.withColumn("token", F.explode_outer("tokens")).join(seen, "token", "left")
    rarest = place.groupBy("tokens", "verdict", "confidence", "support").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("r"))
    return rarest.select(F.col("r.token").alias("token"), "tokens", "verdict", "confidence", "support")


def judge(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", fixed=RULES, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Per row: id, url, host, path, rule, verdict and matched, the mined rule that applies (null: none)."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"), F.concat(F.array(F.lit("")), tokens(F.col(url))).alias("tokens"))
    found = index(rules, pages, url)
    every = pages.sparkSession.range(1).select(
        F.lit("").alias("token"), F.array().cast("array<string>").alias("rule_tokens"), F.lit("allow").alias("verdict"), F.lit(-1.0).alias("confidence"), F.lit(0.0).alias("support")
    )
    lookup = found.withColumnRenamed("tokens", "rule_tokens").unionByName(every)
    if rules.count() <= broadcast_rules:
        lookup = F.broadcast(lookup)
    hits = (
        rows.select("id", "url", "host", "path", "tokens", F.explode_outer("tokens").alias("token"))
        .join(lookup, "token")
        .filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
        .groupBy("id", "url", "host", "path")
        .agg(F.max(F.struct("confidence", "support", "rule_tokens", "verdict")).alias("best"), F.count(F.when(F.col("token") == "", 1)).alias("copies"))
    )
    rule, says = fixed_rule(F.col("host"), F.col("path"), fixed)
    return hits.select(
        F.col("id").alias(id), F.col("url").alias(url), "host", "path", rule.alias("rule"),
        F.coalesce(says, F.col("best.verdict")).alias("verdict"),
        F.when(F.col("best.confidence") >= 0, F.array_join("best.rule_tokens", " ")).alias("matched"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def op1(spark, sf_dir):
    """Pages are labelled by the document that the number in their url names: low quality or toxic ones are bad."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    numbered = pages.select("url", F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*/[^/?#]+/([0-9]{1,18})", 1).alias("n")).filter("n <> ''").select("url", F.col("n").cast("long").alias("doc_id"))
    return judge(pages, mine(numbered.join(labels, "doc_id"))).select("page_id", "host", "path", "rule", "verdict", "matched")
