"""Files as tables: scans, manifests, snapshots, shards, upserts and exports."""

from __future__ import annotations

import hashlib
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.identity import content_hash
from tessera.functions.text import canonical_path, newline_style
from tessera.operators.classify import MAX_BYTES, ignored

#: Folders that no scan enters.
PRUNED = (".git",)
#: So many bytes of a file are hashed at a time.
READ = 4 << 20


def _qualified(spark: SparkSession, root: str):
    """The root's file system and its whole location."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(path).toString().rstrip("/")


def _below(location, top: str):
    """The part of a location after the root's own."""
    return F.substring(location, F.lit(len(top) + 2), F.length(location))


@F.pandas_udf(T.StringType())
def hash_of(locations: pd.Series) -> pd.Series:
    """As `content_hash` of files that Python reaches, a few MB of them at a time."""

    def read(location: str) -> str:
        if location.startswith("file:"):
            system, path = fs.LocalFileSystem(), "/" + location[5:].lstrip("/")
        else:
            system, path = fs.FileSystem.from_uri(quote(location, safe=":/@"))
        found = hashlib.sha256()
        with system.open_input_stream(path) as stream:
            while data := stream.read(READ):
                found.update(data)
        return found.hexdigest()

    return locations.map(read)


def hidden(spark: SparkSession, root: str, prune: tuple[str, ...] = PRUNED) -> tuple[list[str], list[tuple[str, int, int]], list[str]]:
    """(folders, files, nested): what Spark's readers pass over below a root, names that begin with a dot or an underscore: folders, and files with size and time; and the folders
    that are roots of working trees of their own, as they hold `.git`. All are few, and looked for level by level; folders in `prune` are not entered."""
    system, top = _qualified(spark, root)
    visible = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top).select(_below(F.col("path"), top).alias("path"))
    depth = visible.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 1
    folders, files, nested, below = set(), set(), set(), [top]
    while below:
        further = []
        for folder in below:
            for level in range(depth + 1):
                pattern = "/".join([folder, *["*"] * level, "{.*,_*}"])
                for status in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern)) or []:
                    at = status.getPath().toString()
                    parts, name = at[len(folder) + 1 :].split("/"), status.getPath().getName()
                    if name == ".git" and at != f"{top}/.git":
                        nested.add(status.getPath().getParent().toString()[len(top) + 1 :])
                    if any(p[0] in "._" for p in parts[:-1]) or name in prune or status.isSymlink():
                        continue
                    if not status.isDirectory():
                        files.add((at, status.getLen(), status.getModificationTime()))
                    elif at not in folders:
                        folders.add(at)
                        further.append(at)
        below = further
    return sorted(folders), sorted(files), sorted(nested)


def _listing(spark: SparkSession, root: str, pattern: str = "*", paths: list[tuple[str, int, int]] | None = None, prune: tuple[str, ...] = PRUNED) -> DataFrame:
    """(path below the root, size, mtime, content_hash) of all files, hidden ones included, or of those named (location, size, mtime); where the hash isn't selected, or filtered by size, files
    are not read. Working trees within the tree are left out. Local files are hashed a few MB at a time; those in a store that only Spark reaches come whole, one to a task."""
    _, top = _qualified(spark, root)
    folders, single, nested = hidden(spark, root, prune) if paths is None else ([], [], [])
    if paths is not None:
        single = [p for p in paths if p[0].rsplit("/", 1)[-1][0] in "._"]
        paths = [p[0] for p in paths if p not in single]
    rows = spark.createDataFrame(single, "path string, size long, mtime long").select("path", "size", "mtime", hash_of("path").alias("content_hash"))
    if paths is None or paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths or [top, *folders])
        found = hash_of("path") if top.startswith("file:") else content_hash(F.col("content"))
        rows = files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), found.alias("content_hash")).unionByName(rows)
    rows = rows.withColumn("_at", _below(F.col("path"), top)).drop("path")
    for folder in nested:
        rows = rows.filter(~F.col("_at").startswith(f"{folder}/"))
    return rows.select(canonical_path(F.col("_at")).alias("path"), "size", "mtime", "content_hash")


def _kept(rows: DataFrame, prune: tuple[str, ...], rules: list | None) -> DataFrame:
    for folder in prune:
        rows = rows.filter(~(F.col("path").startswith(f"{folder}/") | F.col("path").contains(f"/{folder}/")))
    return rows if not rules else ignored(rows, rules).filter(~F.col("ignored")).drop("ignored")


def ignore_rules(spark: SparkSession, root: str, names: tuple[str, ...] = (".gitignore", ".ignore")) -> list[tuple[str, list[str]]]:
    """(folder, lines) of the ignore files of a tree; lines of later `names` come last and so decide.

    They are configuration, a few lines each, so the driver reads them, in each depth that has files. The tree's own `.git/info/exclude` comes before all.
    """
    depth = _listing(spark, root).agg(F.max(F.size(F.split("path", "/")))).first()[0] or 1
    system, top = _qualified(spark, root)
    found: dict[str, list[str]] = {}
    places = [(".git/info/exclude", "")] + [("/".join([*["*"] * level, name]), None) for name in names for level in range(depth)]
    for place, folder in places:
        for status in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{place}")) or []:
            stream = system.open(status.getPath())
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            own = status.getPath().getParent().toString().removeprefix(top).strip("/") if folder is None else folder
            found.setdefault(own, []).extend(text.split("\n"))
    return sorted(found.items())


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, prune: tuple[str, ...] = PRUNED, rules: list | None = None) -> DataFrame:
    """(path, size, mtime, content_hash) in order of the path; larger files are listed without a hash."""
    rows = _kept(_listing(spark, root), prune, rules)
    # Filters on the size keep larger files from being opened; a condition within a column would not.
    opened = rows.filter(F.col("size") <= max_bytes).select("path", "size", "mtime", "content_hash")
    large = rows.filter(F.col("size") > max_bytes).select("path", "size", "mtime", F.lit(None).cast("string").alias("content_hash"))
    return opened.unionByName(large).orderBy("path")


def scan_paths(spark: SparkSession, root: str, prune: tuple[str, ...] = PRUNED, rules: list | None = None) -> DataFrame:
    return _kept(_listing(spark, root).select("path"), prune, rules).distinct().orderBy("path")


def rescan(spark: SparkSession, root: str, before: DataFrame, strict: bool = False, max_bytes: int = MAX_BYTES, prune: tuple[str, ...] = PRUNED, rules: list | None = None) -> DataFrame:
    """(path, size, mtime, content_hash, reused): as `scan`, but the hash of an unchanged path, size and time is taken over from `before`
    and that file isn't opened; strict: every file is."""
    listed = _kept(_listing(spark, root).select("path", "size", "mtime"), prune, rules)
    if strict:
        return scan(spark, root, max_bytes, prune, rules).withColumn("reused", F.lit(False))
    same = ["path", "size", "mtime"]
    known = listed.join(before.filter("content_hash is not null").select(*same, "content_hash"), same).withColumn("reused", F.lit(True))
    fresh = listed.join(known, same, "left_anti").persist()
    large = fresh.filter(F.col("size") > max_bytes).withColumn("content_hash", F.lit(None).cast("string"))
    # The driver lists every file of a scan anyway; what has changed is opened by name.
    _, top = _qualified(spark, root)
    names = [(f"{top}/{r['path']}", r["size"], r["mtime"]) for r in fresh.filter(F.col("size") <= max_bytes).select("path", "size", "mtime").toLocalIterator()]
    out = known.unionByName(large.withColumn("reused", F.lit(False)))
    if names:
        opened = _listing(spark, root, paths=names).select(*same, "content_hash")
        out = out.unionByName(opened.withColumn("reused", F.lit(False)))
    return out.orderBy("path")


def prepare(files: DataFrame, content: str = "text") -> DataFrame:
    """Encoding, newline style, size and hash of sources."""
    return files.withColumn("encoding", F.lit("utf-8")).withColumn("newline", newline_style(F.col(content))).withColumn("n_bytes", F.octet_length(content)).withColumn("content_hash", content_hash(F.col(content)))


def manifest_hash(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: a hash over the distinct rows in order. Rows are hashed first and the hashes summed in buckets, so nothing is gathered."""
    one = rows.select(F.sha2(F.concat_ws("|", *[F.concat(F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]), 256).alias("h")).distinct()
    part = one.select(F.substring("h", 1, 2).alias("b"), F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)").alias("x"), F.conv(F.substring("h", 16, 15), 16, 10).cast("decimal(38,0)").alias("y"))
    sums = part.groupBy("b").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))  # 256 rows at most
    return sums.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "n", "x", "y"))), lambda r: F.concat_ws(",", r["b"], r["n"].cast("string"), r["x"].cast("string"), r["y"].cast("string"))), ";"), 256).alias("manifest_hash"))


# ---- snapshots


def plan_build(manifest: DataFrame, revisions: DataFrame, fingerprint: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, content_hash, action): reuse a revision of the same content and parser, skip huge files unread, parse the rest."""
    known = revisions.filter(F.col("parser_fingerprint") == fingerprint).select("content_hash").distinct().withColumn("_known", F.lit(True))
    rows = manifest.join(known, "content_hash", "left")
    action = F.when(F.col("size") > max_bytes, "skip_huge").when(F.col("_known"), "reuse").otherwise("parse")
    return rows.select("path", "content_hash", action.alias("action"))


def reconcile(manifest: DataFrame, last_hash: str | None) -> tuple[bool, str]:
    """If there is anything to build, and the manifest's hash."""
    now = manifest_hash(manifest, "path", "content_hash").first()[0]
    return now != last_hash, now


def reconciled(manifest: DataFrame, last: DataFrame) -> DataFrame:
    """One row: the manifest's hash, and if it differs from that of `last`, the manifest that was built last; equal ones need no build."""
    both = manifest_hash(manifest, "path", "content_hash").withColumn("_now", F.lit(1)).unionByName(manifest_hash(last, "path", "content_hash").withColumn("_now", F.lit(0)))
    return both.agg(F.max_by("manifest_hash", "_now").alias("manifest_hash"), (F.countDistinct("manifest_hash") > 1).alias("changed"))


def publish(df: DataFrame, root: str, name: str) -> str:
    """Writes a version and then names it in `_current`: readers see the old or the new one whole."""
    import uuid

    spark, version = df.sparkSession, f"{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{root}/_current_{name}")
    return version


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{spark.read.text(f'{root}/_current_{name}').first()[0]}")


# ---- sinks


def write_shard(points: DataFrame, path: str, id: str = "vec_id", partitions: int = 8) -> None:
    """Vectors as Parquet, in order of the id within each file, so that lookups by id skip row groups."""
    points.repartitionByRange(partitions, id).sortWithinPartitions(id).write.mode("overwrite").parquet(path)


def read_shard(spark: SparkSession, path: str, count: int, dims: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The vectors of a shard. Raises if their number, their dimensions or the uniqueness of their ids isn't as expected."""
    rows = spark.read.parquet(path)
    seen = rows.agg(F.count("*").alias("n"), F.countDistinct(id).alias("ids"), F.count(F.when(F.coalesce(F.size(vector), F.lit(-1)) != dims, 1)).alias("bad")).first()
    if (seen["n"], seen["ids"], seen["bad"]) != (count, count, 0):
        raise ValueError(f"shard has {seen['n']} rows, {seen['ids']} ids and {seen['bad']} vectors of another dimension; {count} of {dims} are expected")
    return rows


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """ON CONFLICT DO UPDATE or, without `update`, DO NOTHING. Of new rows with equal keys the last by all columns counts."""
    once = new.groupBy(*keys).agg(F.max(F.struct(*[c for c in old.columns if c not in keys])).alias("_r")).select(*keys, "_r.*").select(*old.columns)
    if update:
        return old.join(once.select(*keys), keys, "left_anti").select(*old.columns).unionByName(once)
    return old.unionByName(once.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def export(entries: DataFrame, evidence: DataFrame, audits: DataFrame, scopes: list[tuple[str, object]], path: str | None = None) -> DataFrame:
    """Entries of the scopes with evidence and audit trail, by (created_at, entry_id); as JSON lines where a path is given."""
    from tessera.operators.ledger import in_scope, inspect

    rows = None
    for kind, owner in scopes:
        part = in_scope(entries, kind, owner, live_only=False)
        rows = part if rows is None else rows.unionByName(part)
    out = inspect(rows.dropDuplicates(["entry_id"]), evidence, audits)
    if path:
        out.write.mode("overwrite").json(path)
    return out
