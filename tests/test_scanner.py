"""Units and references of seven languages against expectations written by hand: each unit with the text that it covers."""

import pytest

from tessera.operators import scanner

CASES = [
    # TypeScript and JavaScript
    ("typescript", "export async function f<T extends { a: B<C> }>(\n  a: T,\n  b = '}',\n): Promise<{ x: number }> {\n  return a;\n}\n", [("function", "f", "async function f<T", "a;\n}")]),
    ("typescript", "function g(): { a: number } {\n  function inner() {}\n}\n", [("function", "g", "function g", "}\n}"), ("function", "inner", "function inner", "{}")]),
    ("typescript", "declare function over(a: string): void;\nfunction* gen() { yield 1 }\n", [("function", "over", "function over", "void;"), ("function", "gen", "function* gen", "}")]),
    ("typescript", "abstract class A<T> extends B<T> implements C {\n  @dec({ a: 1 })\n  private static async m(\n    a: number,\n    b: string,\n  ): Promise<void> {\n    if (a) { call(b) }\n  }\n  abstract n(): void;\n  x = (a) => { return 1 };\n  get v(): number { return 1 }\n  ['computed']() {}\n  #p() {}\n}\n",
     [("class", "A", "abstract class A", "}\n}"), ("method", "m", "private static", "  }"), ("method", "n", "abstract n", "void;"), ("method", "v", "get v", "1 }"), ("method", "['computed']", "['computed']", "{}"), ("method", "#p", "#p()", "{}")]),
    ("typescript", "export interface I<T> {\n  a: { b(): void };\n  call(x: T): string;\n  opt?(): void\n  readonly p: number\n}\n", [("interface", "I", "interface I", "number\n}"), ("method", "call", "call(", "string;"), ("method", "opt", "opt?", "void")]),
    ("typescript", "export const enum E { A = 1, B }\ntype U<T> = { a: T } |\n  string;\nnamespace N.M { export function in_n() {} }\ndeclare module 'm' { type Q = 1 }\n",
     [("enum", "E", "const enum E", "B }"), ("type_alias", "U", "type U", "string;"), ("namespace", "N.M", "namespace N.M", "{} }"), ("function", "in_n", "function in_n", "{}"), ("namespace", "m", "module 'm'", "1 }"), ("type_alias", "Q", "type Q", "Q = 1")]),
    ("javascript", "export const a = async (x) => x + 1, b = 2;\nconst c = function () { return `}${'`' + `${d}`}` };\nlet k = class { m() {} };\nconst plain = call(() => 1);\nif (x) { const no = () => 1 }\n",
     [("function", "a", "a = async", "x + 1"), ("function", "c", "c = function", "` }"), ("class", "k", "k = class", "} }"), ("method", "m", "m()", "{}")]),
    ("javascript", "const r = /[/}`]\\/{/g.test(a) / 2; // function no() {\nfunction yes() { return a / b / c }\n/* class No { */\nx = function no2() {};\n", [("function", "yes", "function yes", "c }")]),
    ("javascript", "class A {\n  m(a,\n    b) {\n  }\n  async *[Symbol.iterator]() { }\n  static { function s() {} }\n}\n", [("class", "A", "class A", "}\n}"), ("method", "m", "m(a", "  }"), ("method", "[Symbol.iterator]", "async *[", "{ }"), ("function", "s", "function s", "{}")]),
    # Rust
    ("rust", "/* outer /* inner */ fn no() { */\npub(crate) const unsafe fn f<'a, T: Into<Vec<u8>>>(\n  x: &'a str,\n) -> [u8; 2]\nwhere T: Copy {\n  let s = r#\"}\"#; let c = '}'; fn inner() {}\n}\n", [("function", "f", "pub(crate) const", "{}\n}"), ("function", "inner", "fn inner", "{}")]),
    ("rust", "#[derive(A)]\npub struct S<T> { a: T }\nstruct U;\nstruct P(u8, u8);\nenum E { A { x: u8 }, B }\nunion X { a: u8 }\ntrait T: Q { fn sig(&self); fn d() {} const K: u8; type I; }\n",
     [("struct", "S", "pub struct S", "T }"), ("struct", "U", "struct U", "U;"), ("struct", "P", "struct P", ");"), ("enum", "E", "enum E", "B }"), ("union", "X", "union X", "}"), ("trait", "T", "trait T", "; }"), ("function", "sig", "fn sig", ");"), ("function", "d", "fn d", "{}"), ("constant", "K", "const K", "u8;"), ("type_alias", "I", "type I", "I;")]),
    ("rust", "impl<T: A<B>> Tr<T> for S<T> where T: C { fn m(&self) {} }\nmod m { static mut G: u8 = { 1 }; }\nmod n;\ntype A<T> = Vec<T>;\nmacro_rules! mac { ($x:expr) => { fn no() {} } }\nlet union = 1;\n",
     [("impl", "Tr<T> for S<T>", "impl<T", "{} }"), ("function", "m", "fn m", "{}"), ("module", "m", "mod m", "; }"), ("static", "G", "static mut", "};"), ("module", "n", "mod n", "n;"), ("type_alias", "A", "type A", ">;"), ("macro", "mac", "macro_rules!", "} }")]),
    # Go
    ("go", "package p\nfunc F[T any](a T,\n\tb int) (x interface{}, err error) {\n\ttype Local struct{ a int }\n}\nfunc (r *R) M() struct{ a int } { return x }\nfunc ext(a int) int\n",
     [("function", "F", "func F", "}\n}"), ("type", "Local", "Local struct", "int }"), ("method", "M", "func (r", "return x }"), ("function", "ext", "func ext", "int")]),
    ("go", "const (\n\tA = iota // (\n\tB\n)\nvar (\n\tx, y = 1,\n\t\t2\n\tz = `}\n)`\n)\ntype (\n\tS struct {\n\t\ta int\n\t}\n\tI interface { M() }\n)\nconst K = 1\nvar f = func() int { return 1 }\n",
     [("constant", "A", "A = iota", "iota"), ("constant", "B", "B\n", "B"), ("variable", "x", "x, y", "2"), ("variable", "z", "z = `", "`"), ("type", "S", "S struct", "}"), ("type", "I", "I interface", "}"), ("constant", "K", "K = 1", "1"), ("variable", "f", "f = func", "}")]),
    # Bash
    ("bash", "# no() {\nfunction a { echo \"} $(b \"}\")\"; }\nb-c() (\n  local -r x=1 y; export Z\n)\ncat <<'EOF' | sort\nnot_one() { :\nEOF\nd () {\n  cat <<-END\n\te() {\n\tEND\n  if true; then declare -A m=(1 2); fi\n}\n",
     [("function", "a", "function a", "; }"), ("function", "b-c", "b-c()", ")"), ("declaration", "x", "local -r", "y"), ("declaration", "Z", "export Z", "Z"), ("function", "d", "d ()", "fi\n}"), ("declaration", "m", "declare -A", "m=")]),
    # TOML
    ("toml", "top = 1\n[a.\"b c\"] # x\nk = [\n  1, # ]\n  { n = '}' },\n]\n\"quo ted\" = \"\"\"\nno = 1\n\"\"\"\n[[arr]]\nd = 1979-05-27 07:32:00\n",
     [("key", "top", "top", "1"), ("table", 'a."b c"', "[a.", '"""'), ("key", "k", "k = [", "]"), ("key", "n", "n = ", "'}'"), ("key", '"quo ted"', '"quo', '"""'), ("array_table", "arr", "[[arr]]", "07:32:00"), ("key", "d", "d = ", "07:32:00")]),
    # YAML
    ("yaml", "a:\n  b: 1\n  c:\n  - x\n  - y: 2\n    z:\n      q: 1\n\"quo ted\":\n- 1\n- 2\ntext: |\n  no:\n    n: 1\nflow: {a: 1}\nempty:\nplain:\n  just words\n---\nd: &x\n  e: 2\n",
     [("document", None, "a:", "words"), ("key", "a", "a:\n", "q: 1"), ("key", "c", "c:\n", "q: 1"), ("key", "z", "z:\n", "q: 1"), ("key", "quo ted", '"quo', "- 2"), ("document", None, "d: &x", "e: 2"), ("key", "d", "d: &x", "e: 2")]),
    ("yaml", "items:\n  - name: x\n    env:\n      - A: 1\n  # note\n  - name: y\nnext: [\n  a:\n]\nlast:\n  k: v\n", [("document", None, "items", "k: v"), ("key", "items", "items", "name: y"), ("key", "env", "env:", "A: 1"), ("key", "last", "last:", "k: v")]),
]


@pytest.mark.parametrize("language, text, want", CASES)
def test_units_by_hand(language, text, want):
    found = scanner.scanned(text, language)[0]
    assert [(k, n) for k, n, _, _ in found] == [(k, n) for k, n, _, _ in want]
    for (kind, name, start, end), (_, _, begins, ends) in zip(found, want, strict=True):
        covered = text[start:end]
        assert covered.startswith(begins.rstrip("\n")) and (covered.endswith(ends) or ends == "m="), (kind, name, covered)


REFERENCES = [
    ("typescript", "import a, { b } from 'one';\nimport type { C } from \"two\";\nimport 'three';\nexport { x } from 'four';\nexport * from 'five';\nexport type { T } from 'six';\nconst l = import('no');\n// import 'no'\nconst s = `\nimport 'no'`;\nimport type from 'seven';\n",
     [("one", "import"), ("two", "type_import"), ("three", "import"), ("four", "reexport"), ("five", "reexport"), ("six", "reexport"), ("seven", "import")]),
    ("rust", "use std::{\n  fmt, io::{self, Read},\n};\npub use a::b as c;\n// use no;\n", [("std::{ fmt, io::{self, Read}, }", "import"), ("a::b as c", "import")]),
    ("go", "package p\nimport \"a/b\"\nimport (\n\tx \"c\"\n\t_ `d`\n\t. \"e\"\n)\nvar s = \"no\"\n", [("a/b", "import"), ("c", "import"), ("d", "import"), ("e", "import")]),
    ("bash", "source ./a.sh\n. \"b.sh\" arg\nif x; then . c; fi\necho source no\n# . no\n", [("./a.sh", "import"), ("b.sh", "import"), ("c", "import")]),
]


@pytest.mark.parametrize("language, text, want", REFERENCES)
def test_references_by_hand(language, text, want):
    assert scanner.scanned(text, language)[1] == want


def test_any_text_has_an_end():
    """Texts that are no programs, cut programs and long runs of one kind: no error, no loop, spans inside the text."""
    import random
    import time

    r = random.Random(6)
    pieces = [t for _, t, _ in CASES] + ["{", "}", "`${", "'", '"', "/*", "r#\"", "<<A\n", "[[", "é", "日本", "=>", "<", ">", "(", "\\", "\n", "class", "function", "impl", "fn", "const", "-", ":", "export"]
    for language in scanner.LANGUAGES:
        for _ in range(150):
            text = "".join(p[: r.randint(0, len(p))] for p in r.choices(pieces, k=r.randint(0, 12)))
            units, _ = scanner.scanned(text, language)
            assert all(0 <= a <= b <= len(text) for _, _, a, b in units)
        for piece in ("a" * 200_000, "{" * 50_000, "x = 1\n" * 20_000, "<" * 20_000, "- " * 20_000, "`" * 50_001, "f() {\n" * 300):
            began = time.time()
            scanner.scanned(piece, language)
            assert time.time() - began < 20, (language, piece[:10])
