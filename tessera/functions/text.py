"""Scalars over text: normal forms, tokens, scripts, cuts and estimates."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE_CAP = 200
#: Scores of the signal words.
SIGNALS = {"low": 0.3, "medium": 0.6, "high": 0.85}


# ---- normal forms


def normalize_ascii(text: Column) -> Column:
    """Byte order mark off, CRLF and CR to LF, spaces and tabs off the ends of lines; exact for texts already in NFC."""
    out = F.regexp_replace(text, "^﻿", "")
    out = F.regexp_replace(out, "\r\n?", "\n")
    return F.regexp_replace(out, "[ \t]+(\n|$)", "$1")


@F.pandas_udf(T.StringType())
def normalize(texts: pd.Series) -> pd.Series:
    """Byte order mark off, line ends to LF, NFC, then white space off the end of each line."""

    def one(t):
        if t is None:
            return None
        t = unicodedata.normalize("NFC", t.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n"))
        return "\n".join(line.rstrip() for line in t.split("\n"))

    return texts.map(one)


def newline_style(text: Column) -> Column:
    crlf = F.regexp_count(text, F.lit("\r\n"))
    every = F.regexp_count(text, F.lit("\n"))
    return F.when(crlf == 0, "lf").when(crlf == every, "crlf").otherwise("mixed")


def canonical_path(path: Column, fold: bool = False) -> Column:
    """Slashes forward, empty and `.` segments out; `..` stays."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    out = F.array_join(parts, "/")
    return F.lower(out) if fold else out


def remote_url(url: Column) -> Column:
    """`host/path` without scheme, credentials, port and a closing `.git`; the host lower-cased, the path as it is.

    Without a scheme a colon before any slash separates host and path, as in `git@host:path`.
    """
    whole = F.trim(url)
    schemed = whole.contains("://")
    rest = F.regexp_replace(whole, r"^[\s\S]*?://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/]*)", 1), r"^.*@", "")
    host = F.when(schemed, host).otherwise(F.regexp_replace(F.regexp_extract(rest, r"^([^/:]*)", 1), r"^.*@", ""))
    path = F.when(schemed, F.regexp_extract(rest, r"^[^/]*/?([\s\S]*)$", 1)).otherwise(F.regexp_extract(rest, r"^[^/:]*[/:]?([\s\S]*)$", 1))
    path = F.rtrim(F.regexp_replace(F.trim(path, F.lit("/")), r"\.git$", ""), F.lit("/"))
    host = F.lower(F.regexp_extract(host, r"^([^:]*)", 1))
    return F.when(path == "", host).otherwise(F.concat(host, F.lit("/"), path))


def extension(path: Column) -> Column:
    """Lower-case extension of the last segment, `(none)` without one."""
    found = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return F.when(found == "", F.lit("(none)")).otherwise(found)


# ---- tokens


def identifier_tokens(atom: Column) -> Column:
    """ASCII identifiers split at case and digit borders; a single run also comes whole. Distinct, in order, lower-case."""
    runs = F.regexp_extract_all(atom, F.lit(r"[A-Za-z0-9]+"), F.lit(0))
    parts = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[A-Z]|[0-9]+"), F.lit(0))))
    whole = F.when((F.size(runs) == 1) & (F.get(runs, F.lit(0)) == atom), runs).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(whole, parts), F.lower))


def _kind(c: str) -> str:
    return "digit" if c.isdigit() else "upper" if c.isupper() else "lower"


def split_identifier(atom: str | None) -> list[str]:
    """The exact splitter for any script; letters without case count as lower-case ones."""
    atom = unicodedata.normalize("NFC", atom or "")
    runs = re.findall(r"[^\W_]+", atom)
    found = [runs[0].casefold()] if len(runs) == 1 and runs[0] == atom else []
    for run in runs:
        kinds, start = [_kind(c) for c in run], 0
        for i in range(1, len(run)):
            a, b = kinds[i - 1], kinds[i]
            digit = (a == "digit") != (b == "digit")
            rise = a == "lower" and b == "upper"
            last_capital = a == b == "upper" and i + 1 < len(run) and kinds[i + 1] == "lower"
            if digit or rise or last_capital:
                found.append(run[start:i].casefold())
                start = i
        found.append(run[start:].casefold())
    return list(dict.fromkeys(found))


@F.pandas_udf(T.ArrayType(T.StringType()))
def identifier_tokens_any(atoms: pd.Series) -> pd.Series:
    return atoms.map(split_identifier)


def path_tokens(path: Column) -> Column:
    """Tokens of each segment; distinct within a segment only."""
    return F.flatten(F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), identifier_tokens))


def qualified_tokens(name: Column) -> Column:
    """Tokens of the parts between dots and colons."""
    return F.flatten(F.transform(F.filter(F.split(name, "[.:]+"), lambda s: s != ""), identifier_tokens))


def signature_tokens(signature: Column) -> Column:
    """Tokens of all fragments, distinct over all of them."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(signature, F.lit(r"[A-Za-z0-9_]+"), F.lit(0)), identifier_tokens)))


def _accented() -> tuple[str, str]:
    """The letters that are one base letter and marks in canonical decomposition, and their base letters."""
    pairs = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_ACCENTED = _accented()


def without_accents(text: Column) -> Column:
    """Base letters for accented ones up to U+1FFF, marks that stand alone removed; built-in functions only."""
    plain = F.regexp_replace(F.translate(text, *_ACCENTED), r"\p{Mn}+", "")
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(plain)


def body_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits without diacritics."""
    return F.filter(F.split(without_accents(F.lower(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


# ---- measures


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for nothing."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    kinds = F.array_distinct(chars)
    n = F.size(chars)
    share = lambda c: (n - F.size(F.array_remove(chars, c))).cast("double") / n
    return F.when(n == 0, F.lit(0.0)).otherwise(-F.aggregate(kinds, F.lit(0.0), lambda acc, c: acc + share(c) * F.log2(share(c))))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, and eight for the frame."""
    return (F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4) + 8).cast("long")


def prose(text: Column) -> Column:
    """Text without fenced blocks, inline code and urls."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?(```|$)", " ")
    out = F.regexp_replace(out, r"`[^`]*`", " ")
    return F.regexp_replace(out, r"[A-Za-z][A-Za-z0-9+.-]*://\S+", " ")


def script_class(text: Column, least: int = 8, ratio: float = 0.30) -> Column:
    """Undetermined below `least` letters, else non_latin from a share of `ratio` letters outside Latin, else english.

    Built-in functions alone; `script_class_exact` also leaves out every token that says nothing about the language.
    """
    clean = prose(text)
    letters = F.regexp_count(clean, F.lit(r"\p{L}"))
    other = letters - F.regexp_count(clean, F.lit(r"\p{IsLatin}"))
    return F.when(letters < least, "undetermined").when(other / letters >= ratio, "non_latin").otherwise("english")


_PLACE = re.compile(r"://|^www\.|^(?:\.|~)?/|/[^/]*/|@[^.]*\.|\..*@")
_MACHINE = re.compile(r"[A-Za-z0-9+=_-]{12,}")
_CODE = re.compile(r"[;{}]|\(.*\)|\).*\(|::")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f\u1e00-\u1eff]")


def _neutral(token: str) -> bool:
    """Links, paths, ids, identifiers and code."""
    bare = re.sub(r"^[^\w/]+|[^\w/]+$", "", token)
    core = re.sub(r"^\W+|\W+$", "", token)
    if not bare or _PLACE.search(bare) or _CODE.search(token):
        return True
    if _MACHINE.fullmatch(bare) and (re.fullmatch(r"[0-9A-Fa-f-]+", bare) or 4 * len(re.findall(r"[0-9]", bare)) >= len(bare)):
        return True
    falls = [c.islower() for c in core if c.islower() or c.isupper()]
    return "_" in core or "." in core or any(a and not b for a, b in zip(falls, falls[1:]))


def script_of(text: str | None, least: int = 8, ratio: float = 0.30) -> str:
    lines, fenced = [], False
    for line in (text or "").split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced:
            lines.append(line)
    plain = re.sub(r"`[^`]*`", " ", " ".join(lines))
    kept = unicodedata.normalize("NFD", " ".join(t for t in plain.split() if not _neutral(t)))
    letters = [c for c in kept if c.isalpha()]
    other = sum(not _LATIN.match(c) for c in letters)
    return "undetermined" if len(letters) < least else "non_latin" if other >= ratio * len(letters) else "english"


@F.pandas_udf(T.StringType())
def script_class_exact(texts: pd.Series) -> pd.Series:
    return texts.map(script_of)


def signal_score(signal: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SIGNALS.items() for x in kv]), F.lower(signal))


# Base and cap in milliseconds, and the attempt that waits first, of failed runs and of failed reconciles.
RUN_BACKOFF, RECONCILE_BACKOFF = (250, 4_000, 2), (1_000, 300_000, 1)


def backoff(attempt: Column, base: int = RUN_BACKOFF[0], cap: int = RUN_BACKOFF[1], first: int = RUN_BACKOFF[2]) -> Column:
    """Doubles with each attempt from `first` on, up to `cap`; nothing before it."""
    return F.when(attempt < first, F.lit(0)).otherwise(F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.least(attempt - first, F.lit(40))))).cast("long")


def humanized_age(ms: Column, largest: str = "d") -> Column:
    """The two largest units of an age, none beyond `largest` (d, h or m); ages of nothing or less are `just now`."""
    s = F.floor(ms / 1000)
    n = lambda size, wrap=None: F.floor((s % wrap if wrap else s) / size).cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(ms <= 0, "just now")
        .when((s >= 86_400) & F.lit(largest == "d"), say(n(86_400), "d ", n(3_600, 86_400), "h ago"))
        .when((s >= 3_600) & F.lit(largest != "m"), say(n(3_600), "h ", n(60, 3_600), "m ago"))
        .when(s >= 60, say(n(60), "m ago"))
        .otherwise(say(n(1), "s ago"))
    )


# ---- cuts


def utf8_cut(text: Column, cap: int) -> Column:
    """At most `cap` bytes, whole characters only."""
    raw = F.encode(text, "UTF-8")
    head = F.substring(raw, 1, cap)
    # A cut inside a character leaves its first bytes: one to three bytes that are valid only with what follows.
    fits = [F.when(F.is_valid_utf8(F.substring(raw, 1, cap - k)), F.decode(F.substring(raw, 1, cap - k), "UTF-8")) for k in range(1, 4)]
    return F.when(F.octet_length(raw) <= cap, text).otherwise(F.coalesce(F.when(F.is_valid_utf8(head), F.decode(head, "UTF-8")), *fits))


def snippet(text: Column, start: Column, end: Column, cap: int = 8192) -> Column:
    """The bytes from start to end as text, cut to `cap`: (text, full_bytes, full_hash, truncated); null for a bad span."""
    raw = F.encode(text, "UTF-8")
    span = F.substr(raw, (start + 1).cast("int"), (end - start).cast("int"))
    good = (start >= 0) & (start <= end) & (end <= F.octet_length(raw)) & F.is_valid_utf8(span)
    whole = F.decode(span, "UTF-8")
    return F.when(good, F.struct(utf8_cut(whole, cap).alias("text"), (end - start).cast("long").alias("full_bytes"), F.sha2(span, 256).alias("full_hash"), ((end - start) > cap).alias("truncated")))


def recall_line(text: Column, cap: int = 1024) -> Column:
    """One line for a prompt: line ends to spaces, other control characters out, the closing tag escaped, at most `cap` bytes."""
    out = F.regexp_replace(F.translate(text, "\n", " "), r"[\x00-\x1F\x7F-\u009F]", "")
    return utf8_cut(F.replace(out, F.lit("</memory"), F.lit("<\\/memory")), cap)


def recall_block(entries: DataFrame, scope: str, rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """One row, or one for each recall that `by` names: its entries (kind, state, confidence, text), in order, as a block of text; none:
    the empty text.

    The block is a prompt, so the token budget that chose the entries bounds it.
    """
    line = recall_line(F.col("text"))
    said = F.format_string("%d. [%s|%s|c=%.2f|len=%d] %s\n", F.col(rank).cast("int"), "kind", "state", "confidence", F.octet_length(line), line)
    lines = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), said.alias("line"))))
    head = F.concat(F.lit("<memory v=1 n="), F.count("*").cast("string"), F.lit(f" scope={scope}>\n"))
    return entries.groupBy(*(by or [])).agg(F.when(F.count("*") > 0, F.concat(head, F.array_join(F.transform(lines, lambda x: x["line"]), ""), F.lit("</memory>\n"))).otherwise("").alias("block"))


def context_text(path: Column, kind: Column, name: Column, doc: Column, signature: Column, code: Column) -> Column:
    """The labelled lines that are embedded for a unit; absent parts leave no line."""
    short = F.when(F.length(signature) > SIGNATURE_CAP, F.concat(F.substring(signature, 1, SIGNATURE_CAP), F.lit("..."))).otherwise(signature)
    line = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws("\n", line("File", path), line("Type", kind), line("Name", name), line("Doc", doc), line("Sig", short), line("Code", code))
