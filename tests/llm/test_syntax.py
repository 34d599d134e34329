import itertools

import pytest

from seamquarry.llm import syntax as S
from seamquarry.llm.derivative import Grammar

GOOD = {
    "c": [
        "int a;", "struct s { int a : 3; struct { int b; } in; } *p, q[3];\n", "#if A\nint f(int a) {\n#else\nint f(long a) {\n#endif\n return (int)a + sizeof(int) * -1; }\n", "#if 0\n<<<<<<< junk\n#endif\nint x;",
        'static const char *s[] = { [0] = "a" "b", "c\\"", };', "void f(void) { for (int i = 0, j; i < 3; i++, j--) if (x) y(); else if (z) { } else do { } while (0); }", "MODULE_LICENSE(\"GPL\");\nint (*fp)(int, char *) = 0;",
        "int f(a, b) int a; char *b; { return a; }", "void f() { list_for_each(p, head) { p->x = 1; } out: goto out; }", "typedef struct x x_t; enum e { A = 1, B, };", "int f() { x = a < b > c; y = a ? b : c ? d : e; *p = &q[1]; (void)z; return ((struct s){ .a = 1 }).a; }",
        "/* <<<<<<< HEAD */ // >>>>>>> x\nint a; /* [... 3 lines omitted ...] */", "__attribute__((packed)) struct s { int a; } __attribute__((aligned(4)));", "int f(void) { switch (a) { case 1 ... 3: default: break; } }", "#define X(a) \\\n  if (a\nint y;\n", "",
    ],
    "cpp": [
        "template <typename T, int N = 3> class A : public B<T>, private C { public: explicit A(int a) : a_(a), b_{1} {} ~A() override; T operator()(int) const; bool operator==(const A &) const = default; private: int a_; };",
        "namespace a::b { using std::vector; auto f = [&, x = 1](auto y) mutable -> int { return x + y; }; }", "int main() { for (auto &[k, v] : m) { std::map<int, std::vector<int>> z{{1, {2}}}; } try { g(); } catch (...) { throw; } return {}; }",
        'auto s = R"x(un"closed)" {)x";', "enum class E : unsigned { A, B }; constexpr auto n = sizeof...(T);" if False else "enum class E : unsigned { A, B };", "void f() { if (auto p = g(); p) delete[] p; auto q = new int[3]; q = new (buf) T{1}; static_cast<int>(x) >> 2; }",
        'extern "C" { int f(int); }', "template <class... Ts> void f(Ts &&...ts) { (g(std::forward<Ts>(ts)), ...); }", "int X::y = 3; X::X() noexcept(true) = default; int C::f() const & { return a < b && c > d; }",
    ],
    "javascript": [
        "const a = 1\nlet b = a\n  + 2\nfunction f(x, {y = 2, ...z}, ...r) { return }\n", "a = b / c / d; e = /[/)]+/g.test(x); return_ = x => ({ a: 1 })", "class A extends B { #p = 1; static async *m() { yield* x } get v() { return this.#p } }", "x = `a ${b ? `c ${d}` : '}'} e`;",
        "import x, { y as z } from './m.js'\nexport default async function () { for await (const a of b) { } }\nexport * as q from 'q'", "label: for (;;) { if (a) continue label; else break }\ndo x++; while (x < 3)\nif (a?.b?.[c] ?? d) { }", "#!/usr/bin/env node\nswitch (a) { case 1: b(); default: }\ntry { } catch { } finally { }",
        "!function(a,b){\"use strict\";for(var v=0;v<b.length;v++)u.push(b[v])}(1,2);", "{ a: 1 }\n({ 'a': 1 }).b; (function () { })(); yield\n-{ a: 1 }.a", "var o = { get a() { return 1 }, async b() { }, [c]: 1, d, 'e': 2, if: 3 }; o.default.if",
    ],
    "go": [
        "package p\n\nimport (\n\t\"a\"\n\tx \"b\"\n)\n\nconst N = 1\n\nfunc (r *T) f(a, b int, c ...string) (int, error) {\n\tif v, ok := m[k]; ok {\n\t\treturn v, nil\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor k, v := range m {\n\t}\n\treturn 0, err\n}\n",
        "package p\ntype T struct {\n\tA int `json:\"a\"`\n\t*B\n}\ntype I interface {\n\tF(int) error\n\t~int | string\n}\nvar x = map[string][]int{\"a\": {1, 2}}\n", "package p\nfunc f[T any](x T) {\n\tswitch y := x.(type) {\n\tcase int:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\tcase c <- 1:\n\t}\n\tgo func() {}()\n\tdefer f()\n\ta, b = T{1}, &U{X: 2}\n}\n",
    ],
    "python": ["x = f'{a!r:>{w}}'\n", "def f(a, /, b=1, *c, d: int = 2, **e) -> None:\n    '''doc'''\n    return lambda x, *y: x if y else (yield)\n", "match a:\n    case [1, *r] if r:\n        pass\n    case _:\n        pass\nmatch = case = 1\nprint(match)\n", "async def f():\n    async with a as b, c: pass\n    return [x async for x in y if (z := x)]\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\n", "if a:\n\tb\n# comment\n\n  # odd\n\tc\nx = [\n1,\n  2,\n]\ny = a[1:2, ..., ::3]; z = {**a, 'b': 1}\n", "@d.e(1)\nclass A(B, m=C): x: int; y: str = 's'\n", "s = '''\n<<<<<<< ours\n'''\n# [output truncated]"],
}
BAD = {
    "c": ["int f() {", "int f() {\n<<<<<<< HEAD\n}", "int f() { return 1 }", "int f() { a = ; }", "[... 3 lines omitted ...]", 'char *s = "abc;\n', "/* open", "}", "int f() { if (a { } }", "def f(x):\n    return x\n", "package main\nimport \"fmt\"\nfunc main() {\n}\n", "#!/bin/sh\necho hi\n", '{"a": [1, 2]}', "<html></html>", "std::string s;", "int a;\n#if X\nint b;\n", "#endif\n", "int f() { goto; }", "import { a } from './b.js';\n"],
    "cpp": ["class A { public: int a;", "namespace x { int a; ", "int main() { std::vector<int> v(3; }", "<<<<<<< HEAD\nint a;", "void f() { try { } }", "def f(): pass"],
    "javascript": ["function f( { }", "const = 3;", "a b", "if (a) { b(); ", "x = 'abc\n", "#include <stdio.h>\nint main() { }", "def f(x):\n  return x\n", "<<<<<<< HEAD\na()\n", "import x from;", "class A { m( }", "`abc", '{\n  "name": "tank",\n  "rules": [1]\n}\n', "function () { }"],
    "go": ["package p\nfunc f() {", "func f() {}\n", "package p\nx := 1\n", "package p\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}\n", "package p\nfunc f() {\n\ta b\n}\n", "package p\n#include <a>\n"],
    "python": ["def f(:\n  pass\n", "if a:\nb\n", "x = (1,\n", "  x = 1\n", "def f():\n    a\n  b\n", "x = 'a\n", "<<<<<<< HEAD\nx = 1\n", "else:\n    pass\n", "int f(void) { return 0; }\n", "try:\n    pass\n", "print 'a'\n", "x = 1 +\n"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in GOOD.items() for t in ts])
def test_valid(language, text):
    f = S.fault(language, text)
    assert f is None, f.args
    assert S.fault(language, text.replace("\n", "\r\n")) is None


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_invalid(language, text):
    assert S.fault(language, text) is not None


def test_faults_say_where():
    kind, at, token = S.fault("c", "int f() {\n  a = ;\n}\n").args
    assert (kind, at, token) == ("unexpected", 16, ";")
    assert S.fault("go", "package p\nfunc f() {").args[0] == "truncated" and S.fault("python", "x = (1,\n").args[0] == "truncated"


def test_memory_may_go_without_changing_results():
    lang = S._BUILD["c"]()
    lang.grammar.limit = 1
    for _ in range(3):
        lang.check("int f(void) { return 0; }")
        with pytest.raises(S.Fault):
            lang.check("int f(void) { return 0 }")


def test_derivatives_match_the_grammar():
    g = Grammar("s = 'a' s 'b' | [ 'c' ] t ; t = { 'd' | '(' s ')' } ;", "s")

    def words(n):
        s, t = {""}, {""}
        for _ in range(n):
            t = {x for x in {a + b for a in t for b in {"", "d"} | {f"({y})" for y in s}} if len(x) <= n}
            s = {x for x in {f"a{y}b" for y in s} | {c + y for c in ("", "c") for y in t} if len(x) <= n}
        return s

    want = words(5)
    for n in range(6):
        for w in itertools.product("abcd()", repeat=n):
            node = g.start
            for k in w:
                node = g.derive(node, k)
            assert node.null == ("".join(w) in want), w


def test_table(spark):
    df = spark.createDataFrame(
        [(1, "r", "c", "int a;", 0), (1, "r", "c", "int a;", 1), (2, "r", "c", "int a", 0), (3, "r", "go", None, 0), (4, "r", "c", " \n\t", 0), (5, "r", "markdown", "(", 0), (None, "r", "c", "(", 0), (6, None, "python", "x = " + "(" * 3000, 0), (7, "q", None, "(", 0)],
        "request_id bigint, repo string, language string, snippet string, line int",
    )
    done = S.checked(df)
    assert {(r.request_id, r.valid) for r in done.collect()} == {(1, True), (2, False), (6, False)}
    assert {(r.repo, r.language, r.files, r.broken, r.rate) for r in S.rates(done).collect()} == {("r", "c", 2, 1, 0.5), (None, "python", 1, 1, 1.0)}
    assert S.checked(df.limit(0)).count() == 0


def test_python_by_derivatives_alone():
    good = ["x = f'{a['k']} {b!r:>{w}}'\n", 'y = f"{d["k"]} {{}} {x:{"<" + w}}"\n', "z = rf'\\d{n}'\n", "f = 'a' f'b' \"c\"\n", 'g = f"""{a["x"]}\n{b}"""\n', "h = f''\n"]
    for t in good:
        compile(t, "", "exec")
        assert S.fault("python", t) is None, t
    for t in ["x = 'a\n", "x = (1\n", "def f(:\n  pass\n", "if x:\npass\n"]:
        assert S.fault("python", t) is not None, t


@pytest.mark.parametrize("lang,deep", [("python", "x = " + "(" * 4000 + "1" + ")" * 4000 + "\n"), ("javascript", "x = " + "[" * 4000 + "]" * 4000 + ";"), ("c", "int x = " + "(" * 4000 + "1" + ")" * 4000 + ";"), ("go", "package a\nvar x = " + "(" * 4000 + "1" + ")" * 4000 + "\n")])
def test_depth_is_no_fault(lang, deep):
    assert S.fault(lang, deep) is None
    assert S.fault(lang, deep[: len(deep) // 2]) is not None
