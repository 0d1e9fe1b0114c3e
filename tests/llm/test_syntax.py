import ast
import itertools
import re
import warnings

import pytest

from siftline.llm import syntax
from siftline.llm.gll import Grammar

VALID = {
    "c": [
        "int main(void) { return 0; }", "#include <a.h>\n#define X 1\nint x = X;\n", "struct a { int b : 3; union { int c; float d; }; } e[2] = { [0] = { .b = 1 }, { 2 } };",
        "typedef int (*fn)(const char *, ...);\nfn table[] = { 0 };", "void f(int n, int a[static n]) { for (int i = 0; i < n; ++i) { if (a[i]) continue; else break; } }",
        "int g(a, b) int a; char *b; { return a + *b; }", "int h(void) { l: switch (1) { case 1: case 2: goto l; default: ; } do { } while (0); return sizeof(int) + sizeof x + _Alignof(double); }",
        "_Static_assert(1, \"x\");\n_Thread_local static int t;\nint k = _Generic(1, int: 2, default: 3);", "char *s = \"a\" \"b\\\nc\";\nchar c = '\\'';\n/* } */ // {\n", "int x = (int)(unsigned)3 * (y) + (z);",
        "#if A\nint f(void) {\n#else\nint f(int x) {\n#endif\n return 1; }\n", "",
        "#ifdef __cplusplus\nextern \"C\" {\n#endif\nint f(void);\n#if 0\nnot code at all here\n#endif\n#ifdef __cplusplus\n}\n#endif\n",
        "#if A\nint a;\n#elif B\n#ifdef C\nint b;\n#else\nint c;\n#endif\n#else\nint d;\n#endif\n", "int f(void) { a, b, c[1](2)->x.y++, (*d)(e), g * h - i << 2; return 0; }",
    ],
    "cpp": [
        "#include <v>\nnamespace a::b { template <typename T, int N = 3> class X : public Y<T>, private Z { public: X() : y(1), z{2} {} ~X() = default; virtual int f() const override; operator bool() const { return true; } private: int y; }; }",
        "int main() { std::vector<std::vector<int>> v{{1, 2}, {3}}; for (auto &[a, b] : m) { std::cout << a << b << std::endl; } auto f = [&, x = 1](auto y) mutable -> int { return y; }; return f(2); }",
        "template <typename T> concept C = requires(T t) { { t.x() } -> std::same_as<int>; typename T::type; };\ntemplate <C T> void g(T &&t) requires C<T> { if constexpr (sizeof(T) > 1) { co_return; } }",
        "auto s = R\"x( } \" )\" )x\"; long n = 1'000'000; enum class E : int { A, B = 2, };", "int f() try { throw std::runtime_error(\"x\"); } catch (const std::exception &e) { delete[] p; int *q = new int[3]; }",
        "struct P { int x; auto operator<=>(const P &) const = default; friend std::ostream &operator<<(std::ostream &o, const P &p) { return o << p.x; } };\n[[nodiscard]] constexpr int z() noexcept { return a < b && c > d; }",
        "module;\n#include <x>\nexport module a.b:c;\nimport <vector>;\nexport import d.e;\nimport :f;\nexport int g() { return 1; }\n", "import <vector>;\nint module = 1, import = 2;\n",
        "using T = int (*)(int); template <typename... A> auto sum(A... a) { return (a + ... + 0); } static_assert(true);",
    ],
    "java": [
        "package a.b;\nimport java.util.*;\nimport static a.B.c;\npublic class A<T extends B & C> extends D implements E, F { private final Map<String, List<int[]>> m = new HashMap<>(); static { x(); } A(int... a) throws G { this(1); } @Override public <R> R f(T t) { return null; } }",
        "class A { void f() { for (String s : l) { if (s instanceof String t && t.length() > 1) { continue; } } try (R r = g(); s) { } catch (B | C e) { throw e; } finally { } synchronized (this) { i++; } } }",
        "sealed interface S permits A, B {}\nrecord A(int x, String... y) implements S { A { x = 1; } }\nenum E { X(1) { int f() { return 1; } }, Y; E(int... a) {} }\n@interface N { int v() default 1; }",
        'class A { Object f(Object o) { return switch (o) { case Integer i when i > 3 -> "x"; case A(var p, B q) -> { yield 1; } case null, default -> throw new X(); }; } String t = """\n a "b" \\"""\n"""; }',
        "class A { Runnable r = () -> { }; F<G> h = (a, b) -> a + b; I j = x -> y -> z; K k = A::new; L l = int[]::new; char c = '\\u0041'; long n = 0x1FL + 1_000; int[] z = { 1, 2, }; int q = (int) (a) + (b); }",
        "module a.b { requires transitive c; exports d to e, f; provides g with h; }", "",
    ],
    "python": [
        "def f(a, /, b: int = 1, *args, c, d=2, **k) -> None:\n    return a\n", "match x:\n    case [1, *rest] if rest: pass\n    case {'a': b, **c} | None: pass\n    case A(x=1, y=_) as z: pass\n    case -1 | 2+3j: pass\nmatch = 1; case = match\n",
        "async def g():\n    async with a as b, c: await d\n    return [x async for x in y if x if z]\n", "x = f'{a!r:>{w}} {b=} {{}} {c if d else e}' rf'\\{g}'\n", "try:\n  pass\nexcept* (A, B) as e:\n  raise X from e\n",
        "type X[T: int, *Ts, **P] = list[T]\nclass A[T](B, metaclass=C): x: int = 1; y, *z = 1, 2\n", "if (n := 10) > 5: print(n, sep='')\nelif not x: ...\nelse:\n\tpass\n", "a = b = c\nd += yield_\nlambda *a, k=1: (yield)\nx[1:2, ::3, *q] = 1\ndel (a), b[0]\n",
        "with (open('a') as f, open('b') as g,): pass\nfor x, in y: continue\nwhile True: break\nelse: pass\n", "# only a comment", "@a.b(c)\n@d\ndef f(): '''doc\n  string'''\n", "x = (1,\n  # c\n     2)\nif x:\n    y = 1 \\\n        + 2\n\n    z = 3\n", "print(*a, **b, c=1)\nglobal q\nassert a, b\nfrom . import (x as y, z,)\nfrom .a import *\n",
    ],
    "go": [
        'package main\n\nimport (\n\t"fmt"\n\t. "os"\n\tx "a/b"\n)\n\nvar a, b = 1, "x"\nconst (\n\tA = iota\n\tB\n)\ntype T struct {\n\tX, Y int `json:"x"`\n\t*Z\n\tio.Reader\n}\n\nfunc main() {\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor range c {\n\t}\n\tif v, ok := m[k]; ok && v != nil {\n\t\treturn\n\t} else if x {\n\t}\n}\n',
        "package p\nfunc (t *T) F(a, b int, c ...string) (x int, err error) {\n\tdefer func() { recover() }()\n\tgo g(a...)\n\tch <- <-d\n\tselect {\n\tcase v, ok := <-c:\n\tcase c <- 1:\n\tdefault:\n\t}\n\tswitch y := z.(type) {\n\tcase int, *T:\n\tdefault:\n\t\tgoto l\n\t}\nl:\n\treturn a, nil\n}\n",
        "package p\ntype N interface { ~int | ~string; F(int) error }\ntype L[T any, K comparable] struct { m map[K][]T }\nfunc M[T N](x T) *L[T, int] { return &L[T, int]{m: map[int][]T{1: {x}}} }\nvar f = func(a int) func() { return nil }\nvar s = []byte(`a\n{`)\nvar r = 'x' + '\\n' + 0x1p-2 + 1_000\n",
        "package p; func f() { switch { case x > 1: fallthrough; case y: }; a[1:2:3], b = c[:], *d; x.y.z(1)(2)[3] = 4; i++ }",
    ],
}
INVALID = {
    "c": ["#if A\nint a;\n#elif B\n)) garbage ((\n#else\nint b;\n#endif\n", "#if A\nint a;\n#else\n#if B\nint x x x;\n#else\nint b;\n#endif\n#endif\n", "#if A\n#else\n#if B\n#else\n}\n#endif\n#endif\n", "extern \"C\" { int f(void); }", "int f( { }", "int f() { return 1;", "}", "int x", "int f() { a b c; }", "<<<<<<< HEAD\nint x;\n", "int f(void) { if x { } }", "def f():\n  pass\n", "int f() { x = ; }", "char *s = \"abc;\n", "/* open", "#endif\n", "#if A\nint x;\n", "# Title\ntext here\n", "int f() { return (1; }", "int f() { else { } }", "int 9x;", "int x = 09;"],
    "cpp": ["import <vector;\nint x;\n", "int f() { std::vector<int v; }", "class A { int x; }", "namespace a {", "int f() { auto g = [](int x { return x; }; }", "template <typename T void f();", "import os\nos.system('x')\n", "int f() {\n=======\n}", "int f() { return x }", "for (int i = 0; i < 3; i++) { }"],
    "java": ["class A { void f() { int x = 1 } }", "class A { void f() { }", "class A { if (x) { } }", "public void f() { } }", "class A { String s = \"a; }", "class A { int x = 'ab'; }", "import a.b\nclass A {}", "class A { void f() { x.; } }", "class A {\n<<<<<<< ours\n}", "class A { void f() { 1 + 2; } }"],
    "python": ["def f(:\n  pass\n", "print 'x'\n", "if x\n  pass\n", "x = (1, 2\n", "def f():\npass\n", "  x = 1\ny = 2\n", "x = 'abc\n", "f(a=1, b)\n", "f(x for x in y, 1)\n", "def f(a=1, b): pass\n", "1 = x\n", "f() = 1\n", "x = 012\n", "x = 1abc\n", "try:\n  pass\n", "class A\n", "a b\n", "<<<<<<< HEAD\n", "x = f'{a b}'\n", "x = f'{}'\n", "x = f'{a'\n", "if x:\n    a\n  b\n", "if x:\n        a\n\tb\n", "del f()\n", "for f() in x: pass\n", "x = $a\n", "b'é'\n", "'a' b'b'\n", "x = '\\x1'\n", "int main() { return 0; }", "import a.b as c.d\n", "else:\n  pass\n", "return\n  x\n", "(*a)\n"],
    "go": ["func f() {}", "package p\nfunc f() {", "package p\nfunc f() { x := }", "package p\nimport fmt\n", "package p\nfunc f()\n{\n}\nx", "package p\nvar x int = \n", "package p\nfunc f() { if x {\n}\nelse {\n}\n}", "package p\n<<<<<<< HEAD\n", "package p\nfunc f() { a b }", "package p\nvar s = \"a\n", "package p\nx := 1\n", "package p\nvar c = '\\q'\n", "int main() { return 0; }"],
}


@pytest.mark.parametrize(("language", "text"), [(g, t) for g, ts in VALID.items() for t in ts])
def test_accepts(language, text):
    assert syntax.valid(text, language)
    assert syntax.valid(text.replace("\n", "\r\n"), language)


@pytest.mark.parametrize(("language", "text"), [(g, t) for g, ts in INVALID.items() for t in ts])
def test_rejects(language, text):
    assert not syntax.valid(text, language)


def test_python_cases_agree_with_the_parser():
    warnings.simplefilter("ignore")
    for t in VALID["python"]:
        ast.parse(t)
    for t in INVALID["python"]:
        with pytest.raises(SyntaxError):
            ast.parse(t)


def test_every_truncation_agrees_with_the_parser():
    warnings.simplefilter("ignore")
    for text in VALID["python"]:
        for k in range(len(text)):
            part = text[:k]
            try:
                ast.parse(part)
                right = True
            except (SyntaxError, ValueError):
                right = False
            assert syntax.valid(part, "python") == right, part


def test_formatted_strings_at_any_depth():
    warnings.simplefilter("ignore")
    valid = ["f'{d['k']}'", 'x = f"{d["k"]}"', "f'{a\n}'", "f'{a # }\n}'", """x = f\"\"\"{f'{f"{1}"}'}\"\"\"""", "f'{f'{f'{1}'}':>{w}}' 'b'", "f'{a:{b:{c}}}'", "f'{a:\n}'", "f'{x!r:>{w}}{y = }' f''", "rf'\\'{a}'", "f'\\{a}'", "'f\"{'"]
    wrong = ["""x = f"{a + f'{b'}\"""", """x = f\"\"\"{f'{f"{1 2}"}'}\"\"\"""", "f'{f'{f'{}'}'}'", "f'{a:{b:{c:{d}}}}'", "f'{a! r}'", "f'{(}'", "f'{a}}'", "f'{'\\x1'}'", "f'{f'\\x1'}'", "f'{a # }'", "bf'{a}'", "\ue010"]
    for t in valid:
        ast.parse(t)
        assert syntax.valid(t, "python"), t
    for t in wrong:
        with pytest.raises(SyntaxError):
            ast.parse(t)
        assert not syntax.valid(t, "python"), t


def test_any_number_of_indents():
    for k in range(2500):
        blank = "".join("\t" if k >> b & 1 else " " for b in range(12))
        assert syntax.valid(f"if x:\n{blank}y = 1\n", "python")
    assert not syntax.valid("if x:\n        a\n\tb\n", "python") and not syntax.valid("if x:\n    a\n  b\n", "python")


def test_every_reading_is_followed():
    kinds = {c: c for c in "abc()"} | {"NAME": "a"}
    g = Grammar("s = x 'b' | y 'c' ; x = 'a' { 'a' } ; y = 'a' 'a' ; ", kinds)
    both = frozenset(["s"])
    assert g.accepts(both, ["aaab"]) and g.accepts(both, ["aac"]) and not g.accepts(both, ["aaac"]) and not g.accepts(both, ["aa"])
    nullable = Grammar("s = n n 'c' ; n = [ 'a' ] m ; m = { 'b' } ;", kinds)
    assert all(nullable.accepts(both, [t]) for t in ("c", "ac", "abac", "bbabc")) and not nullable.accepts(both, ["aaac"])
    brackets = Grammar("s = '(' p ')' 'c' | '(' q ')' 'b' ; p = 'a' ; q = 'a' [ s ] ;", kinds)
    assert brackets.accepts(both, ["(a)c"]) and brackets.accepts(both, ["(a", "(a", ")c", ")b"]) and not brackets.accepts(both, ["(a(a)c)c"])


def _language(accepted, letters, longest):
    return {w for n in range(longest + 1) for w in map("".join, itertools.product(letters, repeat=n)) if accepted(w)}


@pytest.mark.parametrize(
    ("grammar", "same"),
    [
        ("s = s 'a' | 'b' ;", "s = 'b' { 'a' } ;"),
        ("s = [ 'b' ] s 'a' | 'c' ;", None),
        ("s = t 'a' | 'c' ; t = s 'b' | 'a' ;", None),  # over two rules
        ("s = s s | 'a' | 'b' 'c' ;", "s = ( 'a' | 'b' 'c' ) { 'a' | 'b' 'c' } ;"),
        ("s = n s 'a' | n ; n = [ 'b' ] ;", None),  # hidden behind what may be empty
        ("s = s '(' s ')' | 'a' | s 'b' ;", None),
    ],
)
def test_left_recursion(grammar, same):
    kinds = {c: c for c in "abc()"}
    g, start = Grammar(grammar, kinds), frozenset(["s"])
    letters = "abc" if "(" not in grammar else "ab()"
    got = _language(lambda w: g.accepts(start, [w]) or g.accepts(start, list(w)), letters, 6)
    if same is not None:
        h = Grammar(same, kinds)
        assert got == _language(lambda w: h.accepts(start, [w]), letters, 6)
    rules = {"s = [ 'b' ] s 'a' | 'c' ;": r"b{0,9}ca{0,9}", "s = t 'a' | 'c' ; t = s 'b' | 'a' ;": r"(?:aa|c)(?:ba)*", "s = n s 'a' | n ; n = [ 'b' ] ;": r"b*a*", "s = s '(' s ')' | 'a' | s 'b' ;": None}
    if rules.get(grammar):
        keep = {"s = [ 'b' ] s 'a' | 'c' ;": lambda w: w.count("b") <= w.count("a"), "s = n s 'a' | n ; n = [ 'b' ] ;": lambda w: w.count("b") <= w.count("a") + 1}.get(grammar, lambda w: True)
        assert got == _language(lambda w: re.fullmatch(rules[grammar], w) is not None and keep(w), letters, 6)
    if "(" in grammar:
        assert {"a", "ab", "a(a)", "a(a)b", "ab(a)", "a(ab)b"} <= got and not {"", "b", "(a)", "a()", "a(a", "a)"} & got
    assert got


def test_table(spark):
    df = spark.createDataFrame([(1, "int x;", "C ", "r", 1), (2, "int x", " c", "r", 1), (3, None, "c", "r", 1), (4, " \n\t", "c", "r", 1), (5, "x", None, "r", 1), (6, "fn main() {}", "rust", None, 1), (7, "print 1", "PYTHON", None, 1), (7, "print 1", "PYTHON", None, 1), (8, "int f(void) {" + "{" * 20000 + "}" * 20000 + "}", "c", "r", 1)], "k bigint, code string, g string, repo string, broken int")
    out = syntax.checked(df, id_="k", text="code", language="g", keep=("repo",))
    assert sorted((r.id, r.broken) for r in out.collect()) == [(1, False), (2, True), (7, True), (7, True), (8, False)]
    rates = {(r.repo, r.language): (r.n_files, r.n_broken, r.rate) for r in syntax.rates(out, "repo").collect()}
    assert rates == {("r", "c"): (3, 1, 0.333333), (None, "python"): (2, 2, 1.0)}
    assert syntax.checked(df.limit(0), id_="k", text="code", language="g").count() == 0


def test_samples_in_python_agree_with_the_parser(spark):
    warnings.simplefilter("ignore")
    rows = spark.read.parquet("/root/testdata/sf0.01/samples.parquet").where("lower(trim(language)) = 'python' AND raw_code IS NOT NULL AND trim(raw_code) <> ''").select("raw_code").collect()
    for r in rows:
        if r.raw_code.strip():
            try:
                ast.parse(r.raw_code)
                right = True
            except SyntaxError:
                right = False
            assert syntax.valid(r.raw_code, "python") == right
