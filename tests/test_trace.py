from pyspark.sql import functions as F

from seamquarry.streaming import trace as X

SCHEMA = "record string, record_id string, seq bigint, run_id string, span_id string, parent_span_id string, kind string, name string, status string, duration_ms double, ingested_at string"


def rec(kind, seq, span, parent=None, what="tool", name="n", status=None, ms=None, run="r", rid=None):
    return (kind, rid or f"{run}{seq}{span}{kind}", seq, run, span, parent, None if kind == "event" else what, name, status, ms, "now")


GOOD = [
    rec("span.start", 0, "a", what="run"), rec("span.start", 1, "b", "a"), rec("event", 2, "b"),
    rec("span.end", 3, "b", "a", status="ok", ms=1.0), rec("span.end", 4, "a", what="run", status="ok", ms=2.0),
]


def broken(spark, rows):
    return {r.rule: r.n for r in X.violations(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_each_rule_alone(spark):
    assert broken(spark, GOOD + GOOD[:2]) == {}
    swap = lambda i, *x: GOOD[:i] + list(x) + GOOD[i + 1 :]
    assert broken(spark, swap(2)) == {"seq_gap": 1}
    assert broken(spark, swap(3, rec("event", 3, "b"))) == {"no_end": 1}
    assert broken(spark, swap(1, rec("event", 1, "a"))) == {"no_start": 1, "event_outside": 1}
    assert broken(spark, swap(1, rec("span.start", 1, "b", "zz"))).keys() == {"unknown_parent", "unstable"}
    assert broken(spark, swap(3, rec("span.end", 3, "b", "a", status="odd", ms=-1.0))) == {"bad_status": 1, "bad_duration": 1}
    assert broken(spark, swap(3, rec("span.end", 3, "b", "a", name="m", status="ok", ms=1.0))) == {"unstable": 1}
    assert broken(spark, swap(0, rec("span.start", 0, "a", what="stage"))).keys() == {"roots", "unstable"}
    assert broken(spark, GOOD[:3] + [rec("span.end", 3, "a", what="run", status="ok", ms=2.0), rec("span.end", 4, "b", "a", status="ok", ms=1.0)]) == {"ends_after_parent": 1}
    assert broken(spark, GOOD + [rec("event", 5, "b"), rec("event", 6, "zz")]) == {"event_outside": 2}
    assert broken(spark, GOOD + [rec("span.end", 5, "b", "a", status="ok", ms=1.0)]).keys() == {"many_ends", "ends_after_parent"}
    assert broken(spark, GOOD[:0] + [rec("event", 0, None, rid=None)]) == {"event_outside": 1}
    s = X.summary(spark.createDataFrame(GOOD + GOOD, SCHEMA)).first()
    assert (s.records, s.spans, s.events, s.failed) == (5, 2, 1, 0)


def test_streams_give_what_the_batch_gives(spark, tmp_path):
    late = spark.createDataFrame([GOOD[3], GOOD[4], rec("span.start", 9, "open", "a")], SCHEMA)
    spark.createDataFrame(GOOD[:3] + [GOOD[0]], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "log"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    out = X.drain(spark, X.paired_spans(X.read_stream(spark, str(tmp_path / "log"), 1)))
    assert {(r.span_id, r.kind, r.status, r.duration_ms) for r in out.collect()} == {("a", "run", "ok", 2.0), ("b", "tool", "ok", 1.0)}
    times = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 05:00:00", "x")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    times.coalesce(1).write.parquet(str(tmp_path / "ev"))
    w = X.drain(spark, X.window_counts(X.read_stream(spark, str(tmp_path / "ev")), "ts", "k", "1 hour", "1 hour"))
    assert [(str(r.window_start), r.n) for r in w.collect()] == [("2024-01-01 00:00:00", 2)]
