import json

import pytest
from pyspark.sql import functions as F

from seamquarry.operators import graph as G
from seamquarry.operators import reports as R
from seamquarry.operators import stores as S
from seamquarry.sources import files as Q

RECORDS = "namespace array<string>, key string, value string"


def test_keys_and_namespaces(spark):
    r = spark.createDataFrame([(["a", "b"], "1", "x"), (["a", "c"], "2", "y"), (["d"], "3", None), (None, "4", "z")], RECORDS)
    keys = spark.createDataFrame([("1",), ("1",), ("9",), (None,)], "key string")
    assert [x.key for x in S.fetched(r, keys, ["key"]).collect()] == ["1"] and {x.key for x in S.deleted(r, keys, ["key"]).collect()} == {"2", "3", "4"}
    assert {tuple(x.namespace) for x in S.namespaces(r, 1).collect()} == {("a",), ("d",)} and S.namespaces(r).count() == 3
    assert {x.key for x in S.without_stale(r, {"value": "x"}, "key").collect()} == {"1"} and S.without_stale(r, {}, "key").count() == 4
    fresh = spark.createDataFrame([(["a", "n"], "8", "new")], RECORDS)
    assert {x.key for x in S.refreshed(r.where("namespace is not null"), {("a",): fresh}).collect()} == {"3", "8"}
    with pytest.raises(Exception, match="outside the prefix"):
        S.refreshed(r, {("d",): fresh}).collect()


def test_pages_and_checkpoints(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"), F.lit("x").alias("page"))
    got = S.in_pages(spark, df.drop("page"), ["id"], 90).collect()
    assert all(r.place == r.id and r.page == r.id // 90 for r in got) and len(got) == 1000 and S.in_pages(spark, df.drop("page").limit(0), ["id"], 5).count() == 0
    w = spark.createDataFrame([("a", None), ("a", ""), ("b", "x")], "p string, q string").select(S.checkpoint_key("p", "q").alias("k"))
    assert w.distinct().count() == 3
    done = w.limit(2).withColumn("version", F.lit(1)).withColumn("answer", F.lit('{"a": 1}'))
    assert S.remaining(w, done, "k", 1).count() == 1 and S.remaining(w, done, "k", 2).count() == 3 and S.remaining(w, done.withColumn("answer", F.lit("{")), "k", 1).count() == 3


def test_revisions(spark):
    rows = [(1, 0, "r", "node", "a", "p"), (1, 1, "r", "node", "b", None), (1, 1, "r", "node", "b", None), (2, 1, "r", "node", "a", "p"), (2, 0, "r", "node", "b", None), (3, 0, "s", "node", "a", "p"), (3, 5, "s", "global", "a", "p")]
    m = S.manifests(spark.createDataFrame(rows, "graph_revision bigint, position bigint, repo string, kind string, identity string, payload string"))
    got = {r.graph_revision: r for r in m.collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint and got[1].records == 2 and not got[1].latest and got[2].latest and got[1].complete and not got[3].complete
    none = spark.createDataFrame([], "repo string")
    assert {r.action for r in S.rebuild_plan(m.where("graph_revision = 1"), m.where("graph_revision = 2"), none).collect()} == {"reuse"}
    assert {r.action for r in S.rebuild_plan(m.where("graph_revision = 1"), m.where("graph_revision = 2"), spark.createDataFrame([("r",)], "repo string")).collect()} == {"build"}


def test_path_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    ends = [one(Q.suffix_matches(F.lit(n), p)) for n, p in (("a.min.JS", ".min.js"), ("my_test_x", "test_*"), ("x.gen.c", "*.gen.?"), ("xagenac", "*.gen.?"))]
    assert ends == [True, True, True, False]
    rules = [("c", [".c"], [], 0), ("make", [], ["Makefile"], 5), ("h", [".h"], ["*.h"], 1)]
    assert [one(Q.language_of(F.lit(p), rules)) for p in ("x/a.C", "x/Makefile", "b.h", "b", "x\\y.c")] == ["c", "make", "h", None, "c"]
    with pytest.raises(ValueError):
        Q.language_of(F.lit("x"), [("a", [".x"], [], 0), ("b", [".x"], [], 0)])
    langs = spark.createDataFrame([("m", [".md", ".c"])], "language string, extensions array<string>")
    df = spark.createDataFrame([("a.MD",), ("b.c",), ("c.zip",), (None,)], "p string")
    assert {(r.p, r.part) for r in Q.index_inputs(df, "p", langs).collect()} == {("a.MD", "docs"), ("b.c", "code")}
    paths = spark.createDataFrame([("docs/SECURITY.md",), ("docs/../SECURITY.md",), ("docs\\security.md",), ("docs/SECURITY.exe",)], "p string")
    assert {r.p for r in Q.scanned(paths, "p", ["docs/SECURITY.*"], [".md"]).collect()} == {"docs/SECURITY.md", "docs\\security.md"}
    rev = spark.createDataFrame([(1, '{"reviews": [{"a": 1}, {}]}'), (2, "[]"), (3, None), (4, "{")], "k int, t string")
    assert [(r.k, r.position) for r in Q.findings_json(rev, "k", "t").orderBy("position").collect()] == [(1, 0), (1, 1)]
    assert one(Q.under_parent("/a/work/", F.lit("x.c"))) == "work/x.c"
    assert [one(F.array_join(R.applying(F.lit(p), ["repository", "src/*", "lib"]), ",")) for p in ("src/a", "lib/x", "library/x")] == ["repository,src/*", "repository,lib", "repository"]


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([(1, "a.c", 3, None, 'say "x"\nand y', "High", "CWE-1", 0.5, "r", "m", "c")], "finding_id bigint, file string, line int, end_line int, issue string, severity string, cwe string, confidence double, reasoning string, mitigation string, code_snippet string")
    note = spark.createDataFrame([(1, "kept")], "finding_id bigint, note string")
    assert [Q.write_findings(f, str(tmp_path / n), note) for n in ("r.csv", "r.sarif", "r.html", "r.out", "plain")] == ["csv", "sarif", "html", "json", "json"]
    assert spark.read.json(str(tmp_path / "plain")).first().note == "kept" and "results" in next(tmp_path.glob("r.sarif/part-*")).read_text()
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "r.csv")).first().Issue == 'say "x"\nand y'
    assert Q.planned_outputs({"review": ["out/a.json"], "triage": []}, ["json", "sarif"]) == {"review": ["out/a.json", "out/a.sarif"], "triage": ["triage.json", "triage.sarif"]}
    with pytest.raises(ValueError):
        Q.planned_outputs({"a": ["x.json"], "b": ["x.json"]}, [])
    rec = spark.range(50).select(F.col("id").alias("record_id"))
    for _ in range(2):
        Q.append_trace(spark, rec, ["record_id"], str(tmp_path / "trace"))
    assert sorted(r.seq for r in spark.read.json(str(tmp_path / "trace")).collect()) == list(range(100))
    u = spark.createDataFrame([("s", "m", "o", 100, 25, None), ("s", "m", "p", 40, 10, 50)], "scope_id string, model string, operation string, input_tokens bigint, output_tokens bigint, total_tokens bigint")
    got = json.loads(Q.usage_summary(R.usage_totals(u)).first().summary)
    assert got["total_tokens"] == 175 and len(got["parts"]) == 3
    f.createOrReplaceTempView("seen")
    assert Q.has_columns(spark, "seen", ["file"]) and not Q.has_columns(spark, "seen", ["nope"]) and not Q.has_columns(spark, "unseen", [])


def test_paths_focus_and_order(spark):
    e = spark.createDataFrame([("r", *x) for x in ("ab", "bc", "ac", "cd", "xd", "ef", "dz")], "repo string, src string, dst string")
    ids = lambda s: spark.createDataFrame([("r", x) for x in s], "repo string, id string")
    p = G.source_paths(spark, e, ids("ax"), ids("cdae"))
    assert {(r.target, r.source, tuple(r.path)) for r in p.collect()} == {("c", "a", tuple("ac")), ("d", "x", tuple("xd")), ("a", "a", ("a",))}
    assert {r.id for r in G.focus(e, ids("d"), p.where("target = 'd'")).collect()} == set("dxzc")
    n = ids("abcdefxzq")
    assert {r.id: r.level for r in G.levels(spark, n, e).collect()} == dict(a=0, b=1, c=2, d=3, e=0, f=1, x=0, z=4, q=0)
    with pytest.raises(ValueError):
        G.levels(spark, ids("ab"), spark.createDataFrame([("r", "a", "b"), ("r", "b", "a")], "repo string, src string, dst string"))
    rows = spark.createDataFrame([("r", "p1", 2, 1, "f", 1, "n"), ("r", "p2", 1, 1, "f", 1, "n"), ("r", "p3", 9, 2, "f", 1, "n")], "repo string, path string, hops int, sinks int, file string, line int, name string")
    assert [r.path for r in G.ranked_paths(rows, ["repo"]).orderBy("rank").collect()] == ["p3", "p2", "p1"]
