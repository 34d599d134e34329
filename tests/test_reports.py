import json

from pyspark.sql import functions as F

from seamquarry.operators import reports as R
from seamquarry.operators import retrieval as V
from seamquarry.sources import files as S

FINDING = "finding_id bigint, file string, line int, start_line int, end_line int, issue string, code_snippet string, reasoning string, mitigation string, cwe string, severity string, confidence double, n string"


def rows(spark):
    return spark.createDataFrame(
        [(1, "a/x.c", 5, 5, 6, " i ", "s", None, "", None, "high", 0.5, "q"), (2, "a/x.c", 99, None, None, "j", None, "r", "m", "CWE-1", "CRITICAL ", None, "q"), (3, None, None, None, None, None, None, None, None, "", "odd", float("nan"), None)],
        FINDING,
    )


def test_roll_ups(spark):
    f = R.normalised(rows(spark))
    got = {r.finding_id: (r.issue, r.cwe, r.severity, r.confidence) for r in f.collect()}
    assert got == {1: ("i", "CWE-Unknown", "High", 0.5), 2: ("j", "CWE-1", "Critical", 0.0), 3: ("", "CWE-Unknown", "odd", 0.0)}
    assert {(r.dimension, r.value, r.n) for r in R.severity_counts(f).collect()} == {("severity", "High", 1), ("severity", "Critical", 1), ("severity", "odd", 1), ("cwe", "CWE-Unknown", 2), ("cwe", "CWE-1", 1)}
    assert {(r.file, r.n, r.max_severity) for r in R.file_stats(f).collect()} == {("a/x.c", 2, "Critical"), ("Unknown", 1, "Unknown")}
    assert {(r.folder, r.severity, r.n) for r in R.folder_stats(f).collect()} == {("a", "High", 1), ("a", "Critical", 1), ("Unknown", "odd", 1)}
    assert [x.finding_id for x in R.grouped(f).where("file = 'a/x.c'").first().reviews] == [2, 1]
    assert R.severity_counts(f.limit(0)).count() == 0 and R.file_stats(f.limit(0)).count() == 0


def test_merging_keeps_the_latest_wish(spark):
    ids = spark.createDataFrame([(i,) for i in range(8)], "id bigint")
    d = spark.createDataFrame([(1, [0, 1, 1], 1), (2, [1, 2, 99], 0), (3, [5, 4], 77), (4, [6], 6), (5, None, 3), (6, [7, 98], 7)], "decision_no int, members array<bigint>, representative bigint")
    assert {(r.id, r.representative) for r in R.merge_groups(spark, ids, d).collect()} == {(0, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7)}


def test_annotation_needs_single_keys(spark):
    f = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, "c"), (6, "")], "finding_id int, k string")
    notes = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "u"), ("c", "v"), (None, "n"), ("", "n")], "k string, note string")
    assert {(r.finding_id, r.note) for r in R.annotate(f, notes, "k").collect()} == {(1, "x"), (2, None), (3, None), (4, None), (5, None), (6, None)}


def test_sarif_round_trip(spark, tmp_path):
    f = R.normalised(rows(spark)).where("file is not null")
    res = R.sarif_results(f, spark.createDataFrame([("a/x.c", 40)], "file string, n_lines int"))
    got = {r.finding_id: r for r in res.collect()}
    assert got[2].line == 40 and json.loads(got[2].result)["properties"]["reportedLineNumber"] == 99 and got[1].level == "error"
    S.write_sarif(res.coalesce(1), str(tmp_path / "s"), "tool")
    payload = spark.read.text(str(tmp_path / "s"), wholetext=True).select(F.lit(7).cast("bigint").alias("report_id"), F.col("value").alias("payload"))
    back = {(r.file_path, r.line, r.message, r.source_tool) for r in R.sarif_findings(payload).collect()}
    assert back == {("a/x.c", 5, "i", "tool"), ("a/x.c", 40, "j", "tool")}


def test_sarif_shapes(spark):
    p = json.dumps({"runs": [None, {"tool": None, "results": None}, {"tool": {"driver": {"fullName": "T"}}, "results": [{"message": "m", "locations": []}, None, 4, {"message": {"text": 5}, "ruleId": "r", "locations": [{"physicalLocation": {"region": {"startLine": -3}}}]}, {"properties": {"triaged": True}}]}]})
    df = spark.createDataFrame([(1, p), (2, "﻿" + p), (3, json.dumps(p)), (4, None), (5, ""), (6, "{"), (7, "[]")], "report_id bigint, payload string")
    got = [(r.report_id, r.run_index, r.result_index, r.message, r.line, r.source_tool) for r in R.sarif_findings(df).orderBy("report_id", "result_index").collect()]
    assert got == [x for i in (1, 2, 3) for x in ((i, 2, 0, "m", 1, "T"), (i, 2, 3, "5", 1, "T"))]
    assert R.sarif_findings(df, include_triaged=True).count() == 9


def test_usage(spark):
    e = spark.createDataFrame([("s", "op", "m", 100, 25, None), ("s", None, "m", 40, 10, None), (None, "op", None, -5, None, 7)], "scope_id string, operation string, model string, input_tokens bigint, output_tokens bigint, total_tokens bigint")
    got = {(r.scope, r.model, r.operation, r.grouping): r.total_tokens for r in R.usage_totals(e).collect()}
    assert got[None, None, None, 7] == 182 and got["s", None, None, 3] == 175 and got["s", None, "llm", 2] == 50 and got[None, "unknown", None, 5] == 7
    assert [(r.operation, r.rank) for r in R.operation_report(R.usage_totals(e)).orderBy("rank").collect()] == [("op", 1), ("llm", 2)]


def test_usage_of_attributes_encoded_twice(spark, tmp_path):
    import json

    import duckdb

    from seamquarry.plans import catalog

    one = lambda n: json.dumps({"model": "m", "operation": "op", "input_tokens": n, "output_tokens": 1})
    texts = [one(10), json.dumps(one(200)), "\ufeff" + one(3000), "\ufeff" + json.dumps("\ufeff" + one(40_000)), " " + one(500_000), "{", '"{"', "[1]", '"x"', None]
    rows = [(f"r{i}", "s", "event", "usage", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows + rows[:2], "record_id string, run_id string, record string, name string, attributes string").write.parquet(f"{tmp_path}/runlog.parquet")
    got = [tuple(r) for r in catalog.QUERIES["usage_by_operation"](spark, str(tmp_path)).collect()]
    assert got == [("op", 543_215, 1)]
    con = duckdb.connect()
    con.execute(f"create view runlog as select * from '{tmp_path}/runlog.parquet/*.parquet'")
    assert con.execute(catalog.ORACLE["usage_by_operation"]).fetchall() == got


def test_nearest_matches_brute_force(spark):
    import random

    rng = random.Random(1)
    vs = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(60, [0.0] * 5), (61, None)]
    vs.append((62, vs[3][1]))
    df = spark.createDataFrame(vs, "vec_id bigint, embedding array<double>")
    q = df.where("vec_id % 20 = 0")
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 9)
    good = [v for v in vs if v[1] and any(v[1])]
    want = {(i, j, k + 1) for i, a in good if i % 20 == 0 for k, (_, j) in enumerate(sorted((-cos(a, b), j) for j, b in good if j != i)[:4])}
    assert {tuple(r) for r in V.nearest(q, df, 4, blocks=3).collect()} == want


def test_stores(spark):
    old = spark.createDataFrame([(1, "a", "t0", "t0"), (2, "b", "t0", "t1")], "k int, value string, created_at string, updated_at string")
    new = spark.createDataFrame([(2, "B", "t9"), (3, "C", "t9")], "k int, value string, now string")
    want = {(1, "a", "t0", "t0"), (2, "B", "t0", "t9"), (3, "C", "t9", "t9")}
    once = V.upsert(old, new, ["k"])
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in V.upsert(once, new, ["k"]).collect()}
    docs = spark.createDataFrame([(1, "The Buffer limit"), (2, "buffers limit"), (3, None)], "doc_id int, text string")
    assert [r.doc_id for r in V.text_search(docs, "doc_id", "text", "limit, BUFFER!").collect()] == [1] and V.text_search(docs, "doc_id", "text", "?!").count() == 0
    ns = spark.createDataFrame([(["a", "b", "c"],), (["b"],), ([],)], "ns array<string>")
    assert ns.where(V.namespace_matches(F.col("ns"), prefix=["a"], suffix=["c"])).count() == 1 and ns.where(V.namespace_matches(F.col("ns"), suffix=["a", "b"])).count() == 0
    chunks = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id int, c string")
    fresh = spark.createDataFrame([(2, "Y"), (3, "Z"), (4, "no")], "doc_id int, c string")
    changes = spark.createDataFrame([(1, "removed"), (2, "modified"), (3, "added")], "doc_id int, status string")
    after = V.update_index(chunks, fresh, changes)
    assert {tuple(r) for r in after.collect()} == {(2, "Y"), (3, "Z")} == {tuple(r) for r in V.update_index(after, fresh, changes).collect()}
    assert V.stale(docs, {}).count() == 0 and V.stale(docs, {"text": "buffers limit"}).count() == 2
    b = {(r.doc_id, r.taken, r.truncated) for r in V.budgeted(docs.withColumn("g", F.lit(1)), "g", "doc_id", "text", 20).collect()}
    assert b == {(1, 16, False), (2, 4, True)}


def test_files(spark, tmp_path):
    for name, text in {"src/a.c": "int a;", "src/b.min.js": "x", "docs/r.md": "# r"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {(r.rel_path, r.content) for r in S.source_files(spark, str(tmp_path), ignore=["*.min.js"], exclude=["docs/**"]).collect()}
    assert got == {("src/a.c", "int a;")}
    book = json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", "b"]}, {"cell_type": "markdown", "source": "t"}, {"cell_type": "code", "source": " "}, {"cell_type": "code", "source": "c"}]})
    nb = spark.createDataFrame([(book,), ("not json",), (None,)], "t string")
    assert [r.code for r in S.notebook_code(nb, "t").collect()] == ["# Cell 1\na\nb\n\n# Cell 2\nc", "not json", None]
    S.write_csv(rows(spark), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).columns == ["File", "Line", "Severity", "CWE", "Issue", "Reasoning", "Mitigation", "Confidence"]
    S.write_html(spark, "<t>", {"x": spark.range(3000).withColumn("v", F.lit("</b>"))}, str(tmp_path / "page"))
    assert "&lt;t&gt;" in (tmp_path / "page/index.html").read_text() and spark.read.json(str(tmp_path / "page/data/x")).count() == 3000
