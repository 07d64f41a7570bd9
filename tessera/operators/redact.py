"""Secrets in text: private key headers, known credentials, quoted assignments, and tokens of high entropy."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKER = "[REDACTED]"
# Credential prefixes with their least lengths, keys, and words that show a value to be no secret.
CREDENTIALS = {
    "AKIA": 20, "ASIA": 20, "ghp_": 40, "gho_": 40, "ghs_": 40, "github_pat_": 40, "xoxb-": 20, "xoxp-": 20, "xoxa-": 20, "xoxs-": 20, "sk-": 20,
}
KEYS = ["password", "passwd", "secret", "secret_key", "api_key", "apikey", "api-key", "access_key", "client_secret", "auth_token", "token", "private_key"]
PLACEHOLDERS = ["test", "example", "dummy", "fake", "sample", "placeholder", "changeme", "xxx"]
VOCABULARY = ["secret", "password", "passwd", "token", "apikey", "api_key", "api-key", "credential"]
INTEGRITY = ("sha512-", "sha384-", "sha256-", "sha1-")
ENTROPY_LENGTH, ENTROPY_BITS = 40, 4.5

_PEM = re.compile(rb"^[^\S\n]*-----BEGIN[^\n]*PRIVATE KEY[^\n]*?(?=\r*$)", re.M)
_KEY = re.compile(rb"(?<![A-Za-z0-9_])(?:" + "|".join(sorted(KEYS, key=len, reverse=True)).encode() + rb")(?![A-Za-z0-9_])", re.I)
_VALUE = re.compile(rb"""[ \t]*[=:][ \t]*(?:"([^"\n]{8,})"|'([^'\n]{8,})')""")
# The scheme starts where its run of characters does, so that a long run without `://` is passed once.
_URL = re.compile(rb"""(?<![A-Za-z0-9+.-])[A-Za-z0-9+.-]*+://[^\s"'`<>)]*""")
_TOKEN = re.compile(rb"[A-Za-z0-9_+/=-]+")
_CREDENTIAL = re.compile(b"|".join(b"(?:%s.{%d,})" % (re.escape(p.encode()), n - len(p)) for p, n in CREDENTIALS.items()), re.S)
_NO_SECRET = re.compile("|".join(PLACEHOLDERS + VOCABULARY).encode())


def entropy_bits(data: bytes) -> float:
    n = len(data)
    return -sum(c / n * math.log2(c / n) for c in Counter(data).values())


def _assigned(value: bytes, key: bytes) -> bool:
    squash = lambda b: re.sub(rb"[^a-z0-9]", b"", b.lower())
    sentence = b" " in value and value[:1].isupper()
    return squash(value) != squash(key) and not _NO_SECRET.search(value.lower()) and not sentence


def _entropic(token: bytes) -> bool:
    return any(
        len(p) >= ENTROPY_LENGTH and re.search(rb"[0-9]", p) and re.search(rb"[a-z]", p) and re.search(rb"[A-Z]", p) and entropy_bits(p) >= ENTROPY_BITS
        for p in token.split(b"=")
    )


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret, in bytes, in order of the start."""
    data, found = (text or "").encode(), []
    pem = [(m.start(), m.end()) for m in _PEM.finditer(data)]
    found += [("private_key", a, b) for a, b in pem]
    in_pem, at = {a for a, _ in pem}, 0
    for line in data.split(b"\n"):
        if at not in in_pem and (key := _KEY.search(line)) and (value := _VALUE.match(line, key.end())):
            which = 1 if value[1] is not None else 2
            if _assigned(value[which], key[0]):
                found.append(("assigned_secret", at + value.start(which), at + value.end(which)))
        at += len(line) + 1
    urls = [m.span() for m in _URL.finditer(data)]
    starts = [a for a, _ in urls]
    for m in _TOKEN.finditer(data):
        token = m[0]
        if any(_CREDENTIAL.match(p) for p in re.split(rb"[=+/]", token)):
            found.append(("credential_token", *m.span()))
        elif len(token) >= ENTROPY_LENGTH and not token.startswith(tuple(p.encode() for p in INTEGRITY)) and _entropic(token):
            near = bisect.bisect_right(starts, m.start()) - 1
            if near < 0 or m.end() > urls[near][1]:
                found.append(("high_entropy", *m.span()))
    return sorted(found, key=lambda f: f[1])


def redact_text(text: str | None) -> tuple[str | None, int]:
    """The text with a marker for each secret, overlapping and touching ones as one, and how many there were."""
    if text is None:
        return None, 0
    spans: list[list[int]] = []
    for _, a, b in scan(text):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    data, parts, at = text.encode(), [], 0
    for a, b in spans:
        parts += [data[at:a], MARKER.encode()]
        at = b
    return b"".join([*parts, data[at:]]).decode(), len(spans)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("findings", T.IntegerType())]))
def redact(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([redact_text(t) for t in texts], columns=["text", "findings"])


@F.pandas_udf(T.BooleanType())
def has_secret(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: bool(scan(t))).astype(bool)


def credential_like(text):
    """A built-in test for the credential rule alone, for use in filters."""
    any_of = "|".join(f"{re.escape(p)}[A-Za-z0-9_-]{{{n - len(p)},}}" for p, n in CREDENTIALS.items())
    return text.rlike(rf"(^|[^A-Za-z0-9_-])({any_of})")
