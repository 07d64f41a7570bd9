"""File classification: which files are indexed, and why others are not."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.redact import has_secret

MAX_BYTES = 1024 * 1024
# Extensions that are binary, of configuration, of text and of each language; names of entry points.
BINARY = (
    "png jpg jpeg gif bmp ico webp tiff tif heic avif mp3 wav flac ogg aac mp4 m4a m4v avi mov mkv webm wmv zip gz tgz bz2 xz zst 7z rar tar lz4 "
    "pdf doc docx xls xlsx ppt pptx odt ods woff woff2 ttf otf eot exe dll so dylib a o obj lib class jar wasm pyc pyd sqlite db bin dat pack idx "
    "svg ipynb drawio map"
).split()
CONFIG = "json jsonc json5 ini cfg conf properties env tf tfvars hcl tfstate".split()
TEXT = "md mdx markdown txt rst adoc asciidoc".split()
LANGUAGES = {
    "typescript": ["ts", "tsx", "mts", "cts"], "javascript": ["js", "jsx", "mjs", "cjs"], "rust": ["rs"], "python": ["py", "pyi"],
    "bash": ["sh", "bash"], "go": ["go"], "toml": ["toml"], "yaml": ["yaml", "yml"],
}
ENTRY_POINTS = "__main__.py index.js index.jsx index.ts index.tsx lib.rs main.go main.js main.py main.rs main.ts mod.rs".split()
LFS_LINE = "version https://git-lfs.github.com/spec/v1"
SNIFFED = 8192


def suffix(path: Column) -> Column:
    """Extension of the last segment, lower-case; empty for dotfiles, closing dots and names without one."""
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1))


def is_binary(path: Column, content: Column) -> Column:
    return suffix(path).isin(*BINARY) | F.contains(F.substring(content, 1, SNIFFED), F.unhex(F.lit("00")))


def is_lfs_pointer(text: Column) -> Column:
    first = F.rtrim(F.regexp_extract(text, r"^([^\r\n]*)", 1))
    return (first == LFS_LINE) & text.rlike(r"(?m)^oid sha256:[^\r\n]") & text.rlike(r"(?m)^size \s*\+?[0-9]+\s*$")


def classify(files: DataFrame, path: str = "path", content: str = "content", ignored: Column | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """`files` and `reason`, the first that holds: ignored, huge, lfs, binary, encoding, secret, indexed."""
    raw = F.col(content).cast("binary")
    valid = F.is_valid_utf8(raw)
    text = F.when(valid, F.decode(raw, "UTF-8"))
    reason = (
        F.when(F.coalesce(ignored, F.lit(False)) if ignored is not None else F.lit(False), "ignored")
        .when(F.octet_length(raw) > max_bytes, "huge")
        .when(F.coalesce(is_lfs_pointer(text), F.lit(False)), "lfs")
        .when(is_binary(F.col(path), raw), "binary")
        .when(~valid, "encoding")
    )
    rows = files.withColumn("_early", reason).withColumn("_text", F.when(F.col("_early").isNull(), text))
    return rows.withColumn("reason", F.coalesce("_early", F.when(has_secret(F.col("_text")), "secret"), F.lit("indexed"))).drop("_early", "_text")


def dialect(path: Column) -> Column:
    """The language of a path, else config, text or fallback."""
    ext, out = suffix(path), None
    for name, endings in LANGUAGES.items():
        out = F.when(ext.isin(*endings), name) if out is None else out.when(ext.isin(*endings), name)
    return out.when(ext.isin(*CONFIG), "config").when(ext.isin(*TEXT), "text").otherwise("fallback")


def is_entry_point(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    return F.coalesce(F.get(parts, n - 1).isin(*ENTRY_POINTS) | (F.get(parts, n - 2) == "bin"), F.lit(False))


def path_denied(path: Column, denied: list[str]) -> Column:
    """Whole segments of a denied path at the start, not mere characters."""
    out = F.lit(False)
    for d in denied:
        d = d.strip("/")
        out = out | (path == d) | path.startswith(f"{d}/")
    return out


def remote_allowed(policy: Column, local: Column) -> Column:
    """Local providers always; others only under the two policies that say so."""
    return local | policy.isin("remote_allowed", "remote_redacted")


# ---- ignore rules


def rule_regex(pattern: str) -> tuple[str, bool, bool] | None:
    """(regular expression for a path below the rule's folder, is it an exception, folders only) of an ignore line."""
    p = pattern.rstrip("\n")
    if not p.strip() or p.startswith("#"):
        return None
    allow, p = p.startswith("!"), p.removeprefix("!").rstrip()
    folders, p = p.endswith("/"), p.rstrip("/")
    anchored, p = "/" in p, p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.*", i + 3
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            out, i = out + "[" + p[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in p[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out, allow, folders


def ignored(paths: DataFrame, rules: list[tuple[str, list[str]]], path: str = "path") -> DataFrame:
    """`paths` and `ignored`. `rules`: (folder, lines); the deepest folder decides first, its last fitting line wins, and a parent
    that is ignored takes all below it along."""

    compiled = []
    for folder, lines in sorted(rules, key=lambda r: -len([x for x in r[0].split("/") if x])):
        for line in reversed(lines):
            if made := rule_regex(line):
                compiled.append((folder.strip("/"), *made))

    @F.pandas_udf("boolean")
    def judged(values: pd.Series) -> pd.Series:
        import re

        tests = [(f, re.compile(r), allow, folders) for f, r, allow, folders in compiled]

        def one(p: str | None) -> bool:
            parts = [x for x in (p or "").split("/") if x]
            for n in range(1, len(parts) + 1):
                part, is_folder = "/".join(parts[:n]), n < len(parts)
                for folder, test, allow, folders in tests:
                    below = part if not folder else part[len(folder) + 1 :] if part.startswith(folder + "/") else None
                    if below and (is_folder or not folders) and test.fullmatch(below):
                        if allow:
                            break
                        return True
            return False

        return values.map(one).astype(bool)

    return paths.withColumn("ignored", judged(F.col(path)))
