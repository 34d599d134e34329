import hashlib
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seamquarry.functions import text as T
from seamquarry.operators import snippets as N
from seamquarry.operators import source_text as S


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first().y


def test_lines(spark):
    ls = lambda s: one(spark, s, T.lines_of(F.col("x")))
    assert ls("a\r\nb\rc\n") == ["a", "b", "c"] and ls("a\n\n") == ["a", ""] and ls("") == [] and ls(None) == [] and ls("x") == ["x"]
    df = spark.createDataFrame([(1, "é\nab\n", "k"), (2, None, "k"), (3, "", "k")], "id bigint, t string, line string")
    rows = [tuple(r) for r in S.line_index(df, "id", "t").orderBy("line").collect()]
    assert rows == [(1, 1, "é", 0, 2), (1, 2, "ab", 3, 2)]


def test_hash_folds_every_space(spark):
    want = hashlib.sha256(b"a b").hexdigest()[:16]
    assert {one(spark, s, T.content_hash(F.col("x"))) for s in ("a b", " a \t b\n", "a \x1fb")} == {want}
    assert one(spark, None, T.content_hash(F.col("x"))) is None


def test_small_functions(spark):
    x = F.col("x")
    assert one(spark, "ab", T.token_estimate(x, 4.0)) == 1 and one(spark, "", T.token_estimate(x, 4.0)) == 0
    assert one(spark, "CodeLlama-7b", T.family_ratio(x)) == 3.2 and one(spark, None, T.family_ratio(x)) == 4.0
    assert one(spark, "this Overflow in buf_len and buf_len code xy", T.terms(x)) == ["Overflow", "buf_len"]
    assert one(spark, "f(a); g (b); f(c)", T.call_names(x)) == ["f", "g"]
    assert [one(spark, s, T.sink_type(x)) for s in ("Buffer-Over flow!", None, "--", "a__b")] == ["buffer_over_flow", "other", "other", "a_b"]
    assert [one(spark, s, T.severity_title(x)) for s in (" hIgH ", None, "", "odd ")] == ["High", "Unknown", "Unknown", "odd"]
    assert one(spark, "./a\\b//c", T.repo_path(x)) == "a/b/c"
    assert one(spark, ["a", "b"], T.numbered(x, 9), "array<string>") == " 9: a\n10: b"
    assert one(spark, "aéb", T.byte_slice(x, 1, 3)) == "é" and one(spark, "abc", T.byte_slice(x, -4, 99)) == "abc"
    assert one(spark, "1\n2\n3", T.clipped(x, 2, 100)) == "1\n2\n...[truncated]" and one(spark, "abcd", T.clipped(x, 9, 2)) == "ab\n...[truncated]"
    ctx = lambda n, r=1: one(spark, ["a", "b", "c"], T.window_lines(x, F.lit(n), r), "array<string>")
    assert ctx(1) == "1: a\n2: b" and ctx(3) == "2: b\n3: c" and ctx(99) == "3: c"


def test_ignore_rules(spark):
    rules = ["# note", "*", "!src/", "src/*.tmp", "!src/keep.tmp"]
    got = [one(spark, p, T.ignored(F.col("x"), rules)) for p in ("a.c", "src/a.c", "src/a.tmp", "src/keep.tmp")]
    assert got == [True, False, True, False]
    assert one(spark, "x/tests/y.py", T.ignored(F.col("x"), ["tests/"])) and not one(spark, "mytests/y.py", T.ignored(F.col("x"), ["tests/"]))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\r", max_size=200), st.integers(1, 20))
def test_halving_loses_nothing(text, limit):
    size = lambda s: math.ceil(len(s) / 2) if s else 0
    parts = S.halved(text, limit, 2.0)
    assert "".join(p for p, _ in parts) == text and all(size(p) <= limit for p, _ in parts)


def test_line_windows():
    text = "".join(f"line {i}\n" for i in range(100))
    parts = S.by_lines(text)
    assert [n for _, n in parts] == [1, 26, 51, 76] and all(len(p.splitlines()) <= 40 for p, _ in parts)
    assert S.by_lines("x" * 5000)[0] == ("x" * 5000, 1) and S.by_lines("") == []


def halved_brute(text, limit, size):
    cut = lambda p: [p] if size(p) <= limit else cut(p[: len(p) // 2]) + cut(p[len(p) // 2 :])
    whole = lambda ps: ["".join(ps)] if size("".join(ps)) <= limit else whole(ps[: len(ps) // 2]) + whole(ps[len(ps) // 2 :])
    parts = [p for line in text.splitlines(keepends=True) for p in cut(line)]
    return whole(parts) if parts else []


def test_halving_matches_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join("x" * rng.choice([0, 1, 5, 30, 90]) + "\n" for _ in range(rng.randrange(12)))
        limit = rng.randrange(1, 30)
        assert [p for p, _ in S.halved(text, limit, 4.0)] == halved_brute(text, limit, lambda p: math.ceil(len(p) / 4))
    assert S.halved("a\nb\nc\n", 1, 2.0) == [("a\n", 1), ("b\n", 2), ("c\n", 3)]
    with pytest.raises(ValueError):
        S.halved("ab", 1, 0.4)


def test_byte_offsets_follow_the_text_as_it_is(spark):
    df = spark.createDataFrame([(1, "é\r\nab\rc\n\nd")], "id bigint, t string")
    assert [tuple(r)[1:] for r in S.line_index(df, "id", "t").orderBy("line").collect()] == [(1, "é", 0, 2), (2, "ab", 4, 2), (3, "c", 7, 1), (4, "", 9, 0), (5, "d", 10, 1)]


SOURCE = "int f() {\n  a();\n  return 0;\n}\nint g() {\n  b();\n  other(1);\n  return 0;\n}\n"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab. \n!", max_size=300), st.integers(2, 20))
def test_sentences_cover_the_text(text, limit):
    parts, at = S.by_sentences(text, limit, limit // 3, 2.0), 0
    for p, first in parts:
        place = text.find(p, max(0, at - len(p)))
        assert 0 <= place <= at and len(p) <= limit * 2 and p
        at = max(at, place + len(p))
    assert at == len(text)


def test_profiles(spark):
    df = spark.createDataFrame([(1, "x\n" * 100, "a.sv"), (2, "x\n" * 100, "a.c"), (3, "x\n" * 100, "a.td")], "id bigint, t string, p string").withColumn("profile", S.profile(F.col("p")))
    n = {r.id: r["count"] for r in S.chunks(df, "id", "t", "lines").groupBy("id").count().collect()}
    assert n == {1: 2, 2: 4, 3: 2}


def test_locate():
    here = N.Located(SOURCE, True)
    assert here.find("a();", 2, 2) == ("exact", 2, 2) and here.find("  b();") == ("exact", 6, 6)
    assert here.find("  return 0;") == ("disambiguated", 3, 3)
    assert here.find("  return 0;\n}", 7, 8) == ("disambiguated", 8, 9)
    assert here.find("  return 0;", context="see g here") == ("disambiguated", 8, 8)
    assert here.find("6:   b();\n7:   other(1);", 6, 7) == ("exact", 6, 7) and here.find("6:   b();", 2, 2)[0] == "unresolved"
    assert here.find("x();\n  other( 1 );\nother(1);") == ("fuzzy", 7, 7)
    assert here.find("nothing of it") == here.find("\n \n") == N.Located("").find("a") == ("unresolved", None, None)
    assert here.symbol(2) == "f" and here.symbol(99) is None and here.anchor("exact", 2, 2)[3:6] == (10, 16, "f")


def test_functions_and_spans():
    assert N.function_spans(SOURCE) == [("f", 1, 4), ("g", 5, 9)] and N.nearest_span([("f", 1, 4), ("g", 6, 9)], 5) == (6, 9) and N.nearest_span([], 5) is None
    lines = SOURCE.splitlines()
    assert N.function_text(lines, N.function_spans(SOURCE), 1) == "1: int f() {\n2:   a();\n3:   return 0;\n4: }"
    assert N.function_text(lines, N.function_spans(SOURCE), 1, 22) == "1: int f() {\n2:   a();" and N.function_text(lines, [], 8, 4) == "8:  " and N.function_text([], [], 1) == ""


def test_located_findings(spark):
    files = spark.createDataFrame([("a.c", SOURCE), ("b.c", None)], "path string, source string")
    rows = [(i, "a.c", "  b();", None, None, "") for i in range(1200)] + [(2000, "a.c", None, 1, 1, None), (2001, "b.c", "x", 1, 1, None), (2002, None, "x", 1, 1, None), (2003, "no.c", "x", 1, 1, None)]
    f = spark.createDataFrame(rows, "finding_id bigint, path string, code_snippet string, start_line int, end_line int, context string")
    got = {r.finding_id: tuple(r)[1:4] for r in N.locate_snippets(f, files).collect()}
    assert len(got) == 1204 and all(got[i] == ("exact", 6, 6) for i in range(1200)) and all(got[i] == ("unresolved", None, None) for i in range(2000, 2004))
    assert max(len(r.asked) for r in N.gathered(f, files).collect()) < 600
    docs = spark.createDataFrame([(1, SOURCE, "a.c")], "id bigint, t string, path string")
    parts = N.chunk_anchors(docs, S.chunks(docs, "id", "t", "halved", 6), "id", "t").orderBy("chunk").collect()
    raw = SOURCE.encode()
    assert parts and all(p.confidence == "exact" for p in parts) and [p.first_line for p in parts] == sorted(p.first_line for p in parts) and parts[-1].end_byte == len(raw) - 1
    fn = N.functions_at(f.select("finding_id", "path", F.lit(6).alias("line")), files).where("finding_id = 0").first()
    assert (fn.first_line, fn.last_line) == (5, 9)


def test_diffs(spark):
    patch = "diff --git a/x.c b/x.c\n--- a/x.c\n+++ b/x.c\n@@ -1,2 +1,2 @@\n keep\n-old\n+new\n--- /dev/null\n+++ b/n.c\n@@ -0,0 +1 @@\n+@@ born\n"
    df = spark.createDataFrame([(1, patch, "p"), (2, None, "p"), (3, "no diff", "p")], "id bigint, t string, path string")
    rows = S.diff_lines(df, "id", "t")
    assert [tuple(r) for r in rows.orderBy("path", "line_no").collect()] == [(1, "n.c", "added", 1, 1, "+", "@@ born"), (1, "x.c", "modified", 1, 1, " ", "keep"), (1, "x.c", "modified", 1, 2, "-", "old"), (1, "x.c", "modified", 1, 3, "+", "new")]
    assert {(r.path, r.added) for r in S.added_text(rows, "id").collect()} == {("x.c", "new"), ("n.c", "@@ born")}


def test_chunks_and_copies(spark):
    df = spark.createDataFrame([(1, "a  b", "x"), (2, "a b", "y"), (3, None, "z"), (4, "", "z")], "id bigint, t string, content_hash string")
    got = {r.id: (r.kept, r.group_size) for r in S.copies(df.drop("content_hash"), "id", "t").collect()}
    assert got == {1: (1, 2), 2: (1, 2), 4: (4, 1)}
    ch = S.chunks(df, "id", "t", "halved", 1).collect()
    assert {(r.id, r.chunk_text) for r in ch if r.id == 2} == {(2, "a b")} and not [r for r in ch if r.id == 3]
