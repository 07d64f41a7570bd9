"""Units and references in source code.

Python is parsed exactly, by its own parser. The other languages are matched declaration by declaration with regular expressions, outside
comments and strings; a unit ends where its braces (or, for scripts and tables, the next unit of its level) end, which is an
approximation.
"""

from __future__ import annotations

import ast
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.chunk import enclosing

UNITS = "path string, index int, kind string, name string, start int, end int, parent int, error boolean"
REFERENCES = "path string, reference string, kind string"
_ID = r"[A-Za-z_$][\w$]*"
_JS = [
    ("function", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_ID})"), ("class", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_ID})"),
    ("function", rf"^(?:export\s+)?(?:const|let|var)\s+({_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^)\n]*\)\s*(?::[^=\n]+)?=>|{_ID}\s*=>)"),
    ("class", rf"^(?:export\s+)?(?:const|let|var)\s+({_ID})\s*=\s*class\b"), ("method", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|abstract|get|set)\s+)*\*?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)({_ID})\s*\([^)\n]*\)\s*(?::[^{{\n]+)?\{{"),
]
DECLARATIONS = {
    "javascript": _JS,
    "typescript": _JS + [("interface", rf"^[ \t]*(?:export\s+)?interface\s+({_ID})"), ("enum", rf"^[ \t]*(?:export\s+)?(?:const\s+)?enum\s+({_ID})"), ("type_alias", rf"^[ \t]*(?:export\s+)?type\s+({_ID})\b[^=\n]*="), ("namespace", rf"^[ \t]*(?:export\s+)?(?:namespace|module)\s+({_ID})")],
    "rust": [(k, rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?{w}\s+({_ID})") for k, w in (("function", r"(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+(?:\"[^\"]*\"\s+)?)?fn"), ("struct", "struct"), ("enum", "enum"), ("union", "union"), ("trait", r"(?:unsafe\s+)?trait"), ("module", "mod"), ("constant", r"const(?!\s+(?:fn|unsafe|async))"), ("static", r"static(?:\s+mut)?"), ("type_alias", "type"))] + [("impl", r"^[ \t]*(?:unsafe\s+)?impl(?:<[^{\n]*?>)?\s+([^{\n]+?)\s*(?:where\b|\{)"), ("macro", rf"^[ \t]*macro_rules!\s*({_ID})")],
    "go": [("function", rf"^func\s+({_ID})\s*[\[(]"), ("method", rf"^func\s+\([^)]*\)\s*({_ID})"), ("type", rf"^[ \t]*type\s+({_ID})"), ("constant", rf"^const\s+({_ID})"), ("variable", rf"^var\s+({_ID})")],
    "bash": [("function", rf"^[ \t]*(?:function\s+([\w:.-]+)|([\w:.-]+)\s*\(\s*\))"), ("declaration", rf"^[ \t]*(?:declare|typeset|local|export|readonly)\s+(?:-\w+\s+)*({_ID})")],
    "toml": [("array_table", r"^[ \t]*\[\[([^\]\n]+)\]\]"), ("table", r"^[ \t]*\[([^\[\]\n]+)\]"), ("key", r"^[ \t]*([\w.\"'-]+)[ \t]*=")],
    "yaml": [("key", r"^[ \t]*([\w./-]+):[ \t]*(?:#.*)?$")],
}
IMPORTS = {
    "javascript": [("import", r"""^[ \t]*import\b[^'"\n]*['"]([^'"\n]+)['"]"""), ("reexport", r"""^[ \t]*export\b[^'"\n]*\bfrom\s*['"]([^'"\n]+)['"]""")],
    "typescript": [("type_import", r"""^[ \t]*import\s+type\b[^'"\n]*['"]([^'"\n]+)['"]"""), ("import", r"""^[ \t]*import\b(?!\s+type\b)[^'"\n]*['"]([^'"\n]+)['"]"""), ("reexport", r"""^[ \t]*export\b[^'"\n]*\bfrom\s*['"]([^'"\n]+)['"]""")],
    "rust": [("import", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);")],
    "go": [("import", r"""^import\s+(?:[\w.]+\s+)?["`]([^"`\n]+)["`]"""), ("import", r"""(?<=\n)[ \t]+(?:[\w.]+[ \t]+)?["`]([\w./-]+)["`][ \t]*(?=\n)""")],
    "bash": [("import", r"^[ \t]*(?:source|\.)[ \t]+([^\s;&|]+)")],
}


def python_units(text: str) -> tuple[list[tuple], list[tuple], bool]:
    """((kind, name, start, end), ...), ((reference, kind), ...), parsed or not."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [], [], False
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line.encode()) + 1)
    units, refs = [], []

    def span(node: ast.AST) -> tuple[int, int]:
        first = min([node, *getattr(node, "decorator_list", [])], key=lambda n: n.lineno)
        begin = starts[first.lineno - 1] + (first.col_offset - (1 if first is not node else 0))
        return begin, starts[node.end_lineno - 1] + node.end_col_offset

    def walk(body: list, top: bool, inside_class: bool) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                units.append(("method" if inside_class else "function", node.name, *span(node)))
                walk(node.body, False, False)
            elif isinstance(node, ast.ClassDef):
                units.append(("class", node.name, *span(node)))
                walk(node.body, False, True)
            elif top and isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
                units.append(("variable", node.targets[0].id, *span(node)))
            else:
                for inner in ("body", "orelse", "finalbody"):
                    walk(getattr(node, inner, []) or [], False, inside_class)

    walk(tree.body, True, False)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            refs += [(a.name, "import") for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            refs.append(("." * node.level + (node.module or ""), "import"))
    return units, refs, True


_C_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_DOUBLE, _SINGLE, _BACK = r'"(?:\\[\s\S]|[^"\\\n])*"?', r"'(?:\\[\s\S]|[^'\\\n])*'?", r"`(?:\\[\s\S]|[^`\\])*`?"
#: What is no code: comments and the insides of strings.
_ASIDE = {
    "javascript": "|".join((_C_COMMENT, _DOUBLE, _SINGLE, _BACK)), "typescript": "|".join((_C_COMMENT, _DOUBLE, _SINGLE, _BACK)),
    "rust": "|".join((_C_COMMENT, r'r(#*)"[\s\S]*?"\1', r'"(?:\\[\s\S]|[^"\\])*"?', r"'(?:\\[^\n]{1,10}?|[^'\\\n])'")), "go": "|".join((_C_COMMENT, _DOUBLE, r"'(?:\\[^\n]{1,10}?|[^'\\\n])'", r"`[^`]*`?")),
    "bash": "|".join((r"(?<![^\s;])#[^\n]*", r'"(?:\\[\s\S]|[^"\\])*"?', r"'[^']*'?")), "toml": r"(?m)#[^\n]*$|\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}", "yaml": r"(?<![^\s])#[^\n]*",
}


def code_only(text: str, language: str) -> str:
    """The text with blanks for comments and the insides of strings; every place stays where it is."""

    def blank(m: re.Match) -> str:
        quoted = m[0][0] in "\"'`" and len(m[0]) > 1
        inside = re.sub(r"[^\n]", " ", m[0][1:-1] if quoted else m[0])
        return m[0][0] + inside + m[0][-1] if quoted else inside

    return re.sub(_ASIDE[language], blank, text) if language in _ASIDE else text


#: Kinds whose braces, if any, open on the line they begin on.
_ON_A_LINE = ("variable", "constant", "static", "type_alias", "declaration")


def _end(data: str, start: int, stop: int, far: int = 200) -> int:
    """Where the braces that open on the declaration's first lines close, else the end of its line."""
    line = data.find("\n", start)
    line = len(data) if line < 0 else line
    opened = data.find("{", start)
    semi = data.find(";", start)
    if opened < 0 or (0 <= semi < opened) or opened > line + far:
        return semi + 1 if 0 <= semi <= line else line
    depth = 0
    for i in range(opened, len(data)):
        depth += {"{": 1, "}": -1}.get(data[i], 0)
        if not depth:
            return i + 1
    return stop


def other_units(text: str, language: str) -> tuple[list[tuple], list[tuple]]:
    seen: dict[int, tuple] = {}
    whole, text = text, code_only(text, language)
    for kind, pattern in DECLARATIONS.get(language, []):
        for m in re.finditer(pattern, text, re.M):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            seen.setdefault(start, (kind, next(g for g in m.groups() if g is not None).strip(), start))
    ordered, units = sorted(seen.values(), key=lambda u: u[2]), []
    indent = lambda at: at - (text.rfind("\n", 0, at) + 1)
    for i, (kind, name, start) in enumerate(ordered):
        if language == "toml":
            end = next((s for k, _, s in ordered[i + 1 :] if k != "key"), len(text)) if kind != "key" else _line_end(text, start)
        elif language == "yaml":
            end = next((m.start() for m in re.finditer(r"^[ \t]*[^\s#]", text[_line_end(text, start) :], re.M) if len(m[0]) - 1 <= indent(start)), None)
            end = len(text) if end is None else _line_end(text, start) + end
        else:
            end = _end(text, start, len(text), 0 if kind in _ON_A_LINE else 200)
        units.append((kind, name, start, end))
    # Imports name their source in a string, so they are looked for in the whole text, and count where code begins there.
    refs = [(m[1].strip(), kind) for kind, pattern in IMPORTS.get(language, []) for m in re.finditer(pattern, whole, re.M) if text[m.start() : m.end()].strip()[:1] == m[0].strip()[:1]]
    return [(kind, name, at(start), at(end)) for at in (_bytes_at(whole),) for kind, name, start, end in units], refs


def _bytes_at(text: str):
    """From places in characters to places in bytes."""
    if text.isascii():
        return lambda i: i
    ends = [0, *itertools.accumulate(len(c.encode()) for c in text)]
    return lambda i: ends[i]


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def parse(text: str | None, language: str) -> tuple[list[tuple], list[tuple], bool]:
    """Units with index and parent, references, and if the text could be parsed; the file is unit 0."""
    text = text or ""
    ok = True
    if language == "python":
        units, refs, ok = python_units(text)
    else:
        units, refs = other_units(text, language)
    units = [("file", None, 0, len(text.encode())), *units]
    parent = enclosing([(a, b) for _, _, a, b in units])
    return [(i, kind, name, a, b, parent[i]) for i, (kind, name, a, b) in enumerate(units)], refs, ok


def units(files: DataFrame, path: str = "path", text: str = "text", language: str = "dialect") -> DataFrame:
    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, t, lang in zip(f["path"], f["text"], f["language"]):
                got, _, ok = parse(t, lang)
                rows += [(p, *u, not ok) for u in got]
            yield pd.DataFrame(rows, columns=["path", "index", "kind", "name", "start", "end", "parent", "error"]).astype({"parent": "Int32"})

    return files.select(F.col(path).alias("path"), F.col(text).alias("text"), F.col(language).alias("language")).mapInPandas(found, UNITS)


def references(files: DataFrame, path: str = "path", text: str = "text", language: str = "dialect") -> DataFrame:
    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *r) for p, t, lang in zip(f["path"], f["text"], f["language"]) for r in parse(t, lang)[1]]
            yield pd.DataFrame(rows, columns=["path", "reference", "kind"])

    return files.select(F.col(path).alias("path"), F.col(text).alias("text"), F.col(language).alias("language")).mapInPandas(found, REFERENCES)


def anchors(units: DataFrame, file: str = "path") -> DataFrame:
    """Ordinal among the units of a parent and the anchor: the name, or the ordinal where names collide."""
    from pyspark.sql import Window as W

    family = W.partitionBy(file, "parent")
    named = W.partitionBy(file, "parent", "kind", "name")
    return (
        units.withColumn("ordinal", F.row_number().over(family.orderBy("start", "end", "index")) - 1)
        .withColumn("_same", F.count("*").over(named))
        .withColumn("anchor", F.when(F.col("name").isNotNull() & (F.col("_same") == 1), F.concat(F.lit("name:"), "name")).otherwise(F.concat(F.lit("ordinal:"), "ordinal")))
        .drop("_same")
    )
