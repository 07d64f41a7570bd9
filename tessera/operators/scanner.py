"""Declarations in source code by a scanner: a table of tokens for each language, brackets matched on a stack, and what begins a declaration.

`units` gives (kind, name, start, end) in characters and `references` (text, kind); both rest on tokens, so comments, strings, templates, raw strings and
here-documents hold nothing. Brackets without a partner give `fallback` units: there the text isn't what its language allows.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Names of the languages' words.
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "async", "get", "set", "override", "declare", "accessor"}
_DECLARING = {"declare", "typeset", "local", "export", "readonly"}

_NUMBER = r"(?P<num>\d[\w.]*)"
_NAME = r"(?P<id>[^\W\d][\w$]*|[$#][\w$]+|\$)"
_PUNCT = r"(?P<p>=>|->|::|\.\.\.|[\s\S])"
_COMMON = r"(?P<ws>[^\S\n]+)|(?P<nl>\n)|(?P<line>//[^\n]*)|(?P<block>/\*)"
_QUOTED = r'"(?:\\[\s\S]|[^"\\\n])*"?'
_TABLES = {
    "javascript": re.compile("|".join((_COMMON, rf"(?P<str>{_QUOTED}|'(?:\\[\s\S]|[^'\\\n])*'?)", r"(?P<tick>`)", r"(?P<slash>/)", _NUMBER, _NAME, _PUNCT))),
    "rust": re.compile("|".join((_COMMON, r'(?P<raw>b?r#*")', r"""(?P<str>b?"(?:\\[\s\S]|[^"\\])*"?|b?'(?:\\[^\n]{1,10}?|[^'\\\n])')""", r"(?P<life>'\w+)", _NUMBER, r"(?P<id>r#\w+|[^\W\d]\w*)", _PUNCT))),
    "go": re.compile("|".join((_COMMON, rf"(?P<str>{_QUOTED}|'(?:\\[^\n]{{1,10}}?|[^'\\\n])'|`[^`]*`?)", _NUMBER, _NAME, _PUNCT))),
}
_TABLES["typescript"] = _TABLES["javascript"]
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
#: After these a slash begins a regular expression, and a line goes on.
_BEFORE_VALUE = set("( [ { , ; = : ? ! & | + - * / % ~ ^ < => return typeof case in of delete void throw new else do await yield".split())
_GOES_ON = set(", = : ? & | + - * / % ^ < => . && ( [ { extends implements".split())


#: Brackets within brackets that are looked into.
DEPTH = 100


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    fresh: bool  # a new line begins before it


def _template_end(text: str, at: int) -> int:
    """Where a template that begins at `at` ends; what `${` opens is code, which may hold templates."""
    i, n, depth = at + 1, len(text), []
    while i < n:
        c = text[i]
        if depth and c in "\"'":
            i = re.compile(rf"{c}(?:\\[\s\S]|[^{c}\\\n])*{c}?").match(text, i).end()
            continue
        if c == "\\":
            i += 2
            continue
        if (not depth or depth[-1] == "`") and c == "$" and text[i + 1 : i + 2] == "{":
            depth.append("{")
            i += 2
            continue
        if c == "`":
            if not depth:
                return i + 1
            if depth[-1] == "`":
                depth.pop()
            else:
                depth.append("`")
        elif depth and depth[-1] != "`":
            if c == "{":
                depth.append("{")
            elif c == "}":
                depth.pop()
        i += 1
    return n


def _block_end(text: str, at: int, nested: bool) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" and (nested or not depth) else -1 if m[0] == "*/" else 0
        if not depth:
            return m.end()
    return len(text)


def tokens(text: str, language: str) -> list[Token]:
    table, out, at, fresh = _TABLES[language], [], 0, True
    while at < len(text):
        m = table.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "block":
            end = _block_end(text, at, language == "rust")
            fresh |= "\n" in text[at:end]
        elif kind == "nl":
            fresh = True
        elif kind not in ("ws", "line"):
            if kind == "tick":
                kind, end = "str", _template_end(text, at)
            elif kind == "raw":
                close = '"' + "#" * m[0].count("#")
                found = text.find(close, end)
                kind, end = "str", len(text) if found < 0 else found + len(close)
            elif kind == "slash":
                kind = "p"
                before = out[-1] if out else None
                if before is None or before.text in _BEFORE_VALUE or before.text == "}":
                    found = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])*/\w*").match(text, at)
                    kind, end = ("str", found.end()) if found else (kind, end)
            out.append(Token(kind, text[at:end], at, end, fresh))
            fresh = False
        at = end
    return out


class _Braces:
    """What languages with braces share: tokens, partners of brackets, and the units and references found so far."""

    def __init__(self, text: str, language: str):
        self.text, self.toks = text, tokens(text, language)
        self.n, self.depth = len(self.toks), 0
        self.partner: dict[int, int] = {}
        self.units: list[tuple] = []
        self.refs: list[tuple] = []
        stack: list[int] = []
        for i, t in enumerate(self.toks):
            if t.kind != "p":
                continue
            if t.text in _OPEN:
                stack.append(i)
            elif t.text in _CLOSE:
                if any(_OPEN[self.toks[j].text] == t.text for j in stack[-3:]):
                    while _OPEN[self.toks[stack[-1]].text] != t.text:
                        self._wrong(stack.pop())
                    self.partner[stack[-1]] = i
                    stack.pop()
                else:
                    self._wrong(i)
        for i in stack:
            self._wrong(i)

    def _wrong(self, i: int) -> None:
        self.units.append(("fallback", None, self.begins(i), self.ends(i)))

    def walk(self, i: int, stop: int, top: bool = False) -> None:
        """Declarations among the statements from i to before stop, down to `DEPTH` brackets."""
        if self.depth < DEPTH:
            self.depth += 1
            self.statements(i, stop, top)
            self.depth -= 1

    def t(self, i: int) -> str:
        return self.toks[i].text if 0 <= i < self.n and self.toks[i].kind != "str" else ""

    def _token(self, i: int) -> Token:
        return self.toks[min(max(i, 0), self.n - 1)]

    def begins(self, i: int) -> int:
        return self._token(i).start

    def ends(self, i: int) -> int:
        return self._token(i).end

    def fresh(self, i: int) -> bool:
        return self._token(i).fresh

    def kind(self, i: int) -> str:
        return self.toks[i].kind if 0 <= i < self.n else ""

    def close(self, i: int) -> int:
        """The partner of a bracket, or the last token where it has none."""
        return self.partner.get(i, self.n - 1)

    def past(self, i: int) -> int:
        return self.close(i) + 1 if self.kind(i) == "p" and self.t(i) in _OPEN else i + 1

    def angles(self, i: int) -> int:
        """Past `<...>` at i, if it is one."""
        depth, j = 0, i
        while j < self.n and self.t(i) == "<":
            depth += {"<": 1, ">": -1}.get(self.t(j), 0)
            if not depth:
                return j + 1
            if self.t(j) in (";", "{", "}"):
                if self.t(j) != "{":
                    return i
                j = self.close(j)
            j += 1
        return i

    def add(self, kind: str, name: str | None, first: int, last: int) -> None:
        self.units.append((kind, name, self.begins(first), self.ends(last)))

    def until(self, i: int, stop: int, ends: tuple[str, ...]) -> int:
        """The first of `ends` from i on at this level, or stop."""
        while i < stop and self.t(i) not in ends:
            i = self.past(i)
        return min(i, stop)

    def quoted(self, i: int) -> str:
        return self._token(i).text.strip("\"'`")


class _Script(_Braces):
    """JavaScript and TypeScript."""

    def ends_line(self, i: int) -> bool:
        """Token i begins a new line and doesn't go on with the one before."""
        return self.fresh(i) and self.t(i - 1) not in _GOES_ON and self.t(i) not in _GOES_ON

    def line_end(self, i: int, stop: int) -> int:
        """The last token of the statement that goes on at i."""
        j = i
        while j < stop:
            if self.t(j) == ";":
                return j
            if j > i and self.ends_line(j):
                return j - 1
            j = self.past(j)
        return stop - 1

    def signature_end(self, i: int, stop: int) -> tuple[int, int]:
        """(last token, opening brace of the body or -1) from past the parameters on."""
        typed = self.t(i) == ":"
        j = i + 1 if typed else i
        if typed and self.t(j) == "{":
            j = self.past(j)
        while j < stop:
            if self.t(j) == "{":
                if self.t(j - 1) in ("|", "&", "<", ","):
                    j = self.past(j)
                    continue
                return self.close(j), j
            if self.t(j) in (";", ","):
                return (j if self.t(j) == ";" else j - 1), -1
            if self.ends_line(j):
                return j - 1, -1
            j = self.angles(j) if self.t(j) == "<" and self.angles(j) > j else self.past(j)
        return stop - 1, -1

    def function(self, first: int, i: int, stop: int, kind: str, name: str) -> int:
        """A function or method whose name is before i; returns the token past it."""
        i = self.angles(i)
        if self.t(i) != "(":
            return i + 1
        last, body = self.signature_end(self.close(i) + 1, stop)
        self.add(kind, name, first, last)
        self.walk(i + 1, self.close(i), False)
        if body >= 0:
            self.walk(body + 1, self.close(body), False)
        return last + 1

    def with_body(self, first: int, i: int, stop: int, kind: str, name: str | None, members: bool) -> int:
        j = i
        while j < stop and self.t(j) != "{":
            j = self.angles(j) if self.t(j) == "<" and self.angles(j) > j else self.past(j)
        if j >= stop:
            return i + 1
        self.add(kind, name, first, self.close(j))
        if members:
            self.members(j + 1, self.close(j))
        elif kind == "namespace":
            self.walk(j + 1, self.close(j), False)
        return self.close(j) + 1

    def members(self, i: int, stop: int) -> None:
        while i < stop:
            if self.t(i) in (";", ","):
                i += 1
                continue
            if self.t(i) == "@":
                i += 2
                while self.t(i) == ".":
                    i += 2
                i = self.past(i) if self.t(i) == "(" else i
                continue
            first = i
            while self.t(i) in _MODIFIERS and self.t(i + 1) not in ("(", "=", ";", ":", "?", "<", "}", "!", ","):
                i += 1
            if self.t(i) == "*":
                i += 1
            if self.t(i) == "{":  # static block
                self.walk(i + 1, self.close(i), False)
                i = self.close(i) + 1
                continue
            name = self.text[self.begins(i) : self.ends(self.close(i))] if self.t(i) == "[" else self._token(i).text.strip("\"'")
            named = self.kind(i) in ("id", "str", "num") or self.t(i) == "["
            i = self.past(i) if named else i
            if self.t(i) in ("?", "!"):
                i += 1
            if named and self.t(self.angles(i)) == "(":
                i = max(self.function(first, i, stop, "method", name), i + 1)
                continue
            last = self.line_end(i, stop)
            end = min(self.until(i, last + 1, (",",)), last) if self.t(i) == ":" else last
            self.walk(i, end + 1, False)
            i = max(end + 1, first + 1)

    def value(self, i: int, stop: int) -> str | None:
        """function or class if the value at i is one."""
        i += self.t(i) == "async"
        if self.t(i) in ("function", "class"):
            return self.t(i)
        j = self.angles(i)
        if self.t(j) == "(":
            k = self.close(j) + 1
            if self.t(k) == ":":
                k = self.until(k, stop, ("=>", ";"))
            return "function" if self.t(k) == "=>" else None
        return "function" if self.kind(i) == "id" and self.t(i + 1) == "=>" else None

    def variables(self, i: int, stop: int) -> int:
        """Declarators of a top-level const, let or var; those with a function or class are units."""
        last = self.line_end(i, stop)
        while i <= last:
            end = self.until(i, last + 1, (",",))
            equal = self.until(i, end, ("=",))
            if equal < end and self.kind(i) == "id":
                kind = self.value(equal + 1, end)
                if kind:
                    self.add(kind, self.t(i), i, end - 1 - (self.t(end - 1) == ";"))
                j = equal + 1
                if kind == "class":
                    j = self.until(j, end, ("{",))
                    self.members(j + 1, self.close(j))
                    j = self.close(j) + 1
                elif self.t(j) == "function":
                    j = self.until(j, end, ("(",))
                self.walk(j, end, False)
            i = end + 1
        return last + 1

    def statements(self, i: int, stop: int, top: bool) -> None:
        while i < stop:
            before = self.toks[i - 1] if i else None
            starts = before is None or before.kind != "str" and (before.text in (";", "{", "}", ")") or before.text == "else") or self.fresh(i) and before.text not in _BEFORE_VALUE
            if not starts or self.kind(i) != "id":
                if self.t(i) in _OPEN:
                    self.walk(i + 1, self.close(i), False)
                i = self.past(i)
                continue
            j, exported = i, False
            while self.t(j) in ("export", "default", "declare"):
                exported |= self.t(j) == "export"
                j += 1
            if self.t(i) == "import" or exported and self.t(j) in ("{", "*", "type") and self._source(j, stop):
                last = self.line_end(i, stop)
                source = next((k for k in range(i, last + 1) if self.kind(k) == "str"), None)
                if source is not None and self.t(i + 1) != "(" and self.t(i + 1) != ".":
                    self.refs.append((self.quoted(source), "reexport" if exported else "type_import" if self.t(i + 1) == "type" and self.t(i + 2) != "from" else "import"))
                i = last + 1
                continue
            first, word = j, self.t(j)
            if word in ("async", "abstract") and self.t(j + 1) in ("function", "class"):
                j += 1
                word = self.t(j)
            if word == "const" and self.t(j + 1) == "enum":
                j += 1
                word = "enum"
            named = self.kind(j + 1) == "id"
            if word == "function":
                k = j + 1 + (self.t(j + 1) == "*")
                if self.kind(k) == "id":
                    i = self.function(first, k + 1, stop, "function", self.t(k))
                    continue
            elif word == "class" and named:
                i = self.with_body(first, j + 2, stop, "class", self.t(j + 1), True)
                continue
            elif word == "interface" and named:
                i = self.with_body(first, j + 2, stop, "interface", self.t(j + 1), True)
                continue
            elif word == "enum" and named:
                i = self.with_body(first, j + 2, stop, "enum", self.t(j + 1), False)
                continue
            elif word == "type" and named and self.t(self.angles(j + 2)) == "=":
                last = self.line_end(j, stop)
                self.add("type_alias", self.t(j + 1), first, last)
                i = last + 1
                continue
            elif word in ("namespace", "module") and (named or self.kind(j + 1) == "str"):
                k = j + 2
                while self.t(k) == ".":
                    k += 2
                if self.t(k) == "{":
                    i = self.with_body(first, k, stop, "namespace", self.text[self.begins(j + 1) : self.ends(k - 1)].strip("\"'"), False)
                    continue
            elif top and word in ("const", "let", "var"):
                i = self.variables(j + 1, stop)
                continue
            i = j + 1 if j > i else self.past(i)

    def _source(self, j: int, stop: int) -> bool:
        last = self.line_end(j, stop)
        return any(self.t(k) == "from" and self.kind(k + 1) == "str" for k in range(j, last))


class _Rust(_Braces):
    def statements(self, i: int, stop: int, top: bool) -> None:
        while i < stop:
            before = self.t(i - 1) if i else ""
            if self.kind(i) != "id" or not (i == 0 or before in (";", "{", "}", "]", ")")):
                if self.t(i) in _OPEN:
                    self.walk(i + 1, self.close(i))
                i = self.past(i)
                continue
            i = self.item(i, stop)

    def item(self, first: int, stop: int) -> int:
        j = first
        if self.t(j) == "pub":
            j += 1
            j = self.past(j) if self.t(j) == "(" else j
        while self.t(j) in ("default", "async", "unsafe", "extern") or self.t(j) == "const" and self.t(j + 1) in ("fn", "async", "unsafe", "extern"):
            j += 1
            j += self.kind(j) == "str"
        word, name = self.t(j), self.t(j + 1)
        if word == "fn" and self.kind(j + 1) == "id":
            end = self.until(j + 2, stop, ("{", ";"))
            self.add("function", name, first, self.close(end) if self.t(end) == "{" else end)
            return self._inside(end)
        if word in ("struct", "enum", "trait", "mod") or word == "union" and self.kind(j + 1) == "id" and self.t(self.angles(j + 2)) in ("{", "where"):
            end = self.until(j + 2, stop, ("{", ";"))
            self.add({"mod": "module"}.get(word, word), name, first, self.close(end) if self.t(end) == "{" else end)
            return self._inside(end)
        if word == "impl":
            start = self.angles(j + 1)
            end = self.until(start, stop, ("{", ";"))
            where = self.until(start, end, ("where",))
            self.add("impl", " ".join(self.text[self.begins(start) : self.ends(where - 1)].split()), first, self.close(end))
            return self._inside(end)
        if word in ("const", "static", "type"):
            k = j + 1 + (self.t(j + 1) == "mut")
            if self.kind(k) == "id" and (word == "type" or self.t(k + 1) == ":"):
                end = self.until(k, stop, (";",))
                self.add({"const": "constant", "static": "static", "type": "type_alias"}[word], self.t(k), first, end)
                self.walk(k + 1, end)
                return end + 1
        if word == "macro_rules" and name == "!":
            end = self.close(j + 3)
            self.add("macro", self.t(j + 2), first, end)
            return end + 1
        if word == "use":
            end = self.until(j, stop, (";",))
            if end > j + 1:
                self.refs.append((" ".join(self.text[self.begins(j + 1) : self.ends(end - 1)].split()), "import"))
            return end + 1
        return j + 1 if j > first else self.past(first)

    def _inside(self, end: int) -> int:
        if self.t(end) == "{":
            self.walk(end + 1, self.close(end))
            return self.close(end) + 1
        return end + 1


class _Go(_Braces):
    def line_end(self, i: int, stop: int) -> int:
        j = i
        while j < stop:
            if self.t(j) == ";":
                return j - 1
            if j > i and self.fresh(j) and self.t(j - 1) not in _GOES_ON:
                return j - 1
            j = self.past(j)
        return stop - 1

    def statements(self, i: int, stop: int, top: bool) -> None:
        while i < stop:
            starts = i == 0 or self.fresh(i) or self.t(i - 1) in (";", "{")
            word = self.t(i) if starts and self.kind(i) == "id" else ""
            if word == "func" and (self.kind(i + 1) == "id" or self.t(i + 1) == "(" and self.kind(self.close(i + 1) + 1) == "id" and self.t(self.close(i + 1) + 2) in ("(", "[")):
                i = self.function(i, stop)
            elif word in ("type", "const", "var", "import") and self.kind(i + 1) in ("id", "str") or word and word in ("type", "const", "var", "import") and self.t(i + 1) in ("(", "."):
                if self.t(i + 1) == "(":
                    j, end = i + 2, self.close(i + 1)
                    while j < end:
                        if self.t(j) == ";":
                            j += 1
                            continue
                        j = self.spec(word, j, end)
                    i = end + 1
                else:
                    i = self.spec(word, i + 1, stop)
            else:
                if self.t(i) in _OPEN:
                    self.walk(i + 1, self.close(i))
                i = self.past(i)

    def spec(self, word: str, i: int, stop: int) -> int:
        last = max(self.line_end(i, stop), i)
        if word == "import":
            self.refs += [(self.quoted(k), "import") for k in range(i, last + 1) if self.kind(k) == "str"]
        else:
            self.add({"type": "type", "const": "constant", "var": "variable"}[word], self.t(i), i, last)
            self.walk(i + 1, last + 1)
        return last + 1

    def function(self, first: int, stop: int) -> int:
        i, kind = first + 1, "function"
        if self.t(i) == "(":
            i, kind = self.close(i) + 1, "method"
        name, j = self.t(i), i + 1
        j = self.past(j) if self.t(j) == "[" else j
        j = self.past(j)
        while j < stop and self.t(j) != "{" and not self.fresh(j):
            j = self.past(j + 1) if self.t(j) in ("interface", "struct") and self.t(j + 1) == "{" else self.past(j)
        if self.t(j) == "{" and j < stop and not self.fresh(j):
            self.add(kind, name, first, self.close(j))
            self.walk(j + 1, self.close(j))
            return self.close(j) + 1
        self.add(kind, name, first, j - 1)
        return j


# ---- languages without a bracket for each block

_SHELL = re.compile(
    r"""(?P<ws>(?:[^\S\n]|\\\n)+)|(?P<nl>\n)|(?P<comment>\#[^\n]*)|(?P<here><<-?[^\S\n]*(?P<q>['"]?)(?P<tag>[\w.-]+)(?P=q))|(?P<op>;;|&&|\|\||[;&|()]|<<<|[<>]&?)
|(?P<word>(?:\\[\s\S]|'[^']*'?|\$'(?:\\.|[^'\\])*'?|"(?:\\[\s\S]|\$\((?:[^()]|\([^()]*\))*\)|[^"\\])*"?|\$\{[^}]*\}?|\$\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)?|`[^`]*`?|[^\s;&|()<>'"`\\])+)|(?P<other>[\s\S])""",
    re.X,
)


def _shell(text: str) -> tuple[list[tuple], list[tuple]]:
    units, refs, opened, words, pending = [], [], [], [], []
    at, waits = 0, None  # `waits`: (start, name) of a function whose body is to come

    def command() -> None:
        nonlocal words
        if words and words[0][0] in _DECLARING:
            name = next((w for w, _, _ in words[1:] if not w.startswith(("-", "+"))), None)
            if name and re.match(r"[A-Za-z_]\w*", name):
                units.append(("declaration", re.match(r"[A-Za-z_]\w*", name)[0], words[0][1], words[-1][2]))
        elif len(words) > 1 and words[0][0] in ("source", "."):
            refs.append((words[1][0].strip("\"'"), "import"))
        words = []

    def end_of(kind: str, end: int) -> None:
        for k in range(len(opened) - 1, -1, -1):
            if opened[k][0] == kind:
                _, start, name = opened[k]
                del opened[k:]
                if name is not None:
                    units.append(("function", name, start, end))
                return
        units.append(("fallback", None, end - 1, end))

    while at < len(text):
        m = _SHELL.match(text, at)
        kind, end, word = m.lastgroup, m.end(), m[0]
        if kind == "q" or kind == "tag":
            kind = "here"
        if kind == "here":
            pending.append((m["tag"], "-" in m[0][:3]))
        elif kind == "nl":
            command()
            for tag, tabs in pending:
                close = re.compile(rf"^{chr(92)}t*{re.escape(tag)}$" if tabs else rf"^{re.escape(tag)}$", re.M).search(text, end)
                end = close.end() if close else len(text)
            pending = []
        elif kind == "op":
            following = re.compile(r"\([^\S\n]*\)").match(text, at)
            if word == "(" and len(words) == 1 and following and not waits:
                waits, words, end = (words[0][1], words[0][0]), [], following.end()
            elif word == "(":
                command()
                opened.append(("(", *(waits or (at, None))))
                waits = None
            elif word == ")":
                command()
                if any(o[0] == "(" for o in opened):
                    end_of("(", end)
            elif not word.startswith(("<", ">")):
                command()
        elif kind == "word":
            if word == "{" and not words:
                opened.append(("{", *(waits or (at, None))))
                waits = None
            elif word == "}" and not words:
                end_of("{", end)
            elif word in ("then", "do", "else", "elif", "if", "while", "until", "!", "time") and not words:
                pass
            elif not words and word == "function":
                found = re.compile(r"function[^\S\n]+([^\s(){};]+)(?:[^\S\n]*\([^\S\n]*\))?").match(text, at)
                if found:
                    waits, end = (at, found[1]), found.end()
            else:
                words.append((word, at, end))
        at = end
    command()
    units += [("fallback", None, start, start + 1) for _, start, name in opened if name is None] + [("function", name, start, len(text)) for _, start, name in opened if name is not None]
    return units, refs


_T_STRING = re.compile(r'"""(?:\\[\s\S]|[^\\])*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:\\[^\n]|[^"\\\n])*"?|\'[^\'\n]*\'?')
_T_KEY = re.compile(r"""(?:[\w-]+|"(?:\\.|[^"\\\n])*"|'[^'\n]*')(?:[^\S\n]*\.[^\S\n]*(?:[\w-]+|"(?:\\.|[^"\\\n])*"|'[^'\n]*'))*""")
_T_SKIP = re.compile(r"(?:\s|#[^\n]*)*")


def _toml(text: str) -> tuple[list[tuple], list[tuple]]:
    units, table, at, last = [], None, 0, 0

    def value(i: int, depth: int = 0) -> int:
        """Past the value at i; the pairs of inline tables are units, too."""
        if text[i : i + 1] in "\"'":
            return max(_T_STRING.match(text, i).end(), i + 1) if i < len(text) else i
        if text[i : i + 1] not in ("[", "{") or depth > 100:
            return max(re.compile(r"[^\s,\]}#]*(?:[^\S\n]+\d[^\s,\]}#]*)?").match(text, i).end(), i)
        table_of, i = text[i] == "{", i + 1
        while i < len(text):
            i = _T_SKIP.match(text, i).end()
            if text[i : i + 1] in ("]", "}", ""):
                return min(i + 1, len(text))
            if text[i] == ",":
                i += 1
                continue
            key = _T_KEY.match(text, i) if table_of else None
            equal = re.compile(r"[^\S\n]*=[^\S\n]*").match(text, key.end()) if key else None
            end = value(equal.end() if equal else i, depth + 1)
            if equal:
                units.append(("key", key[0], i, end))
            i = max(end, i + 1)
        return i

    def close() -> None:
        if table:
            units.append((*table, last))

    while (at := _T_SKIP.match(text, at).end()) < len(text):
        head = re.compile(r"(\[\[?)[^\S\n]*(" + _T_KEY.pattern + r")[^\S\n]*\]\]?", re.X).match(text, at) if text[at] == "[" else None
        key = _T_KEY.match(text, at) if not head else None
        equal = re.compile(r"[^\S\n]*=[^\S\n]*").match(text, key.end()) if key else None
        if head:
            close()
            table, last = ("array_table" if head[1] == "[[" else "table", head[2], at), head.end()
            at = head.end()
        elif equal:
            end = value(equal.end())
            units.append(("key", key[0], at, end))
            at = last = max(end, at + 1)
        else:
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            units.append(("fallback", None, at, end))
            at = last = end
    close()
    return units, []


_Y_KEY = re.compile(r"""(?P<key>"(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s#&*!|>'"%@`\[\]{},-][^#\n]*?|-[^\s#][^#\n]*?)[^\S\n]*:(?=\s|$)[^\S\n]*(?P<rest>[^\n]*)""")


def _yaml(text: str) -> tuple[list[tuple], list[tuple]]:
    units, keys, document = [], [], None  # keys: [column, name, start, what it holds]
    at, last, scalar, flow = 0, 0, None, 0  # end of the last line with content; column that a block scalar is deeper than; open flow brackets

    def close(column: int, entry: bool) -> None:
        while keys and (keys[-1][0] > column or keys[-1][0] == column and not (entry and keys[-1][3] in ("", "list"))):
            _, name, start, holds = keys.pop()
            if holds in ("map", "list"):
                units.append(("key", name, start, last))

    def ended() -> None:
        nonlocal document
        close(-1, False)
        if document is not None:
            units.append(("document", None, document, last))
        document = None

    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        body = line.strip()
        column = len(line) - len(line.lstrip(" "))
        if scalar is not None and (not body or column > scalar):
            last = start + len(line.rstrip()) if body else last
            continue
        scalar = None
        if re.match(r"(---|\.\.\.)(\s|$)", line):
            ended()
            flow = 0
            continue
        if not body or body.startswith("#") or column == 0 and body.startswith("%"):
            continue
        document = start + column if document is None else document
        if flow:
            flow += sum(map(line.count, "[{")) - sum(map(line.count, "]}"))
            last = start + len(line.rstrip())
            continue
        rest, entry = line[column:], False
        while (dash := re.match(r"-(?:\s+|$)", rest)) is not None:
            close(column, True)
            if keys and keys[-1][3] == "" and keys[-1][0] <= column:
                keys[-1][3] = "list"
            entry, column, rest = True, column + dash.end(), rest[dash.end() :]
        found = _Y_KEY.match(rest)
        if found:
            close(column, False)
            if keys and keys[-1][3] == "" and keys[-1][0] < column:
                keys[-1][3] = "map"
            given = re.sub(r"(^|\s)#.*$", "", found["rest"]).strip()
            plain = re.sub(r"^(?:[&!][^\s]*\s*)+", "", given)
            keys.append([column, found["key"].strip("\"'"), start + column, "" if not plain else "value"])
            if re.match(r"[|>][-+\d]*$", plain):
                scalar = column
            elif plain[:1] in ("[", "{"):
                flow = max(0, sum(map(plain.count, "[{")) - sum(map(plain.count, "]}")))
        elif rest and not entry:
            close(column, False)
            if keys and keys[-1][3] == "" and keys[-1][0] < column:
                keys[-1][3] = "value"
        if re.search(r"(?:^|\s)[|>][-+\d]*$", rest) and not found:
            scalar = column - 1
        last = start + len(line.rstrip())
    ended()
    return units, []


_BRACES = {"javascript": _Script, "typescript": _Script, "rust": _Rust, "go": _Go}
_OTHERS = {"bash": _shell, "toml": _toml, "yaml": _yaml}
LANGUAGES = (*_BRACES, *_OTHERS)


def scanned(text: str, language: str) -> tuple[list[tuple], list[tuple]]:
    """((kind, name, start, end), ...) in order of their places and ((reference, kind), ...); other languages have none."""
    if language in _BRACES:
        found = _BRACES[language](text, language)
        found.walk(0, found.n, True)
        units, refs = found.units, found.refs
    elif language in _OTHERS:
        units, refs = _OTHERS[language](text)
    else:
        return [], []
    return sorted(units, key=lambda u: (u[2], -u[3], u[0])), refs
