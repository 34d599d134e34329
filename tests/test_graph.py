import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from seamquarry.functions.text import SINK_CALLS
from seamquarry.operators import c_facts as C
from seamquarry.operators import c_flow as W
from seamquarry.operators import graph as G


@pytest.mark.parametrize("core_rows", [10**6, 0])
def test_components_match_union_find(spark, core_rows):
    rng = random.Random(3)
    ids, pairs = list(range(150)), [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3)]
    lead = list(ids)

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in pairs:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            lead[b] = a
    got = {r.id: r.component for r in G.components(spark, spark.createDataFrame([(i,) for i in ids], "id bigint"), spark.createDataFrame(pairs, "a bigint, b bigint"), core_rows).collect()}
    assert got == {i: find(i) for i in ids}
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert G.components(spark, spark.createDataFrame([(1,)], "id bigint"), none).first().component == 1


def test_routes_match_breadth_first_search(spark):
    rng = random.Random(4)
    e = sorted({(f"r{rng.randrange(2)}", f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(45)})
    starts, goals = [("r0", "n0"), ("r1", "n1"), ("r0", "lonely")], [("r0", "n3"), ("r0", "n0"), ("r1", "n9"), ("r1", "n2"), ("r0", "lonely")]
    want = {}
    for r, s in starts:
        dist, todo = {s: 0}, deque([s])
        while todo:
            n = todo.popleft()
            for rr, a, b in e:
                if rr == r and a == n and b not in dist:
                    dist[b] = dist[n] + 1
                    todo.append(b)
        want |= {(r, s, g): dist[g] for rr, g in goals if rr == r and g in dist and dist[g] <= 3}
    df = spark.createDataFrame(e, "repo string, src string, dst string")
    ends = lambda x: spark.createDataFrame(x, "repo string, id string")
    rows = G.shortest_routes(spark, df, ends(starts), ends(goals), most_nodes=4).collect()
    assert {(r.repo, r.start, r.goal): r.hops for r in rows} == want and len(rows) == len(want)
    for r in rows:
        assert all((r.repo, a, b) in e for a, b in zip(r.path, r.path[1:]))


def test_call_resolution_prefers_the_own_file(spark):
    n = spark.createDataFrame(
        [("r", "a::f", "a", "f", 1, ["g", "h", "x", "g"], True, False), ("r", "a::g", "a", "g", 9, None, False, False), ("r", "b::g", "b", "g", 1, [], False, True), ("r", "b::h", "b", "h", 2, ["h"], False, False), ("r", "c::h", "c", "h", 2, ["g"], False, False)],
        "repo string, id string, file_path string, name string, line int, calls array<string>, is_source boolean, is_sink boolean",
    )
    calls = G.resolve_calls(n)
    got = {(r.caller, r.symbol, r.callee, r.resolution) for r in calls.collect()}
    assert got == {("a::f", "g", "a::g", "resolved"), ("a::f", "h", "b::h", "ambiguous"), ("a::f", "h", "c::h", "ambiguous"), ("a::f", "x", None, "unresolved"), ("b::h", "h", "b::h", "resolved"), ("c::h", "g", "a::g", "ambiguous"), ("c::h", "g", "b::g", "ambiguous")}
    e = G.edges(calls)
    assert {r.id for r in G.automatic_sources(n, e).collect()} == {"a::f"}
    kept, inner = G.induced(n, e, n.where("file_path = 'a'"))
    assert kept.count() == 2 and [(r.src, r.dst) for r in inner.collect()] == [("a::f", "a::g")]
    assert {(r.dst, tuple(r.callers)) for r in G.reverse_edges(e).collect()} >= {("a::g", ("a::f", "c::h"))}


def test_innermost_span(spark):
    spans = spark.createDataFrame([("r", "f", "outer", 1, 9), ("r", "f", "in_b", 3, 5), ("r", "f", "in_a", 3, 6), ("r", "g", "other", 1, 99), ("r", "f", "null", None, 4)], "repo string, file string, id string, start_line int, end_line int")
    places = spark.createDataFrame([(1, "r", "f", 4), (2, "r", "f", 8), (3, "r", "f", 50), (4, "r", "f", None)], "place_id int, repo string, file string, line int")
    assert {(r.place_id, r.id) for r in G.enclosing(spans, places).collect()} == {(1, "in_a"), (2, "outer")}


def test_round_robin_choice(spark):
    rows = [("A", "x", 1), ("A", "x", 2), ("A", "x", 3), ("A", "y", 4), ("B", "x", 5), ("B", "z", 6), ("B", "z", 7)]
    df = spark.createDataFrame(rows, "g string, b string, k int")
    got = [(r.g, r.k) for r in G.diverse(df, "g", "b", ["k"], 2, 3, 5).orderBy("pick").collect()]
    assert got == [("A", 1), ("B", 5), ("A", 4), ("B", 6), ("A", 2)]


CODE = """#include <x.h>
/* int hidden(int a) { return 0; } */
static int helper(int a, char *b)
{
    // memcpy(a, b);
    const char *s = "call(me)";
    mutex_lock(&dev->state.lock);
    while (a > 0) { a -= step(a, (b, 1), s); }
    mutex_unlock(&dev->state.lock);
    return a + 1;
}
void Box::fill(void) const {
    other->memcpy(x, y);
    memcpy(p, q, sizeof(*p));
    helper(1, 2);
    helper(1);
}
int declared(int a);
"""


def test_c_facts(spark):
    df = spark.createDataFrame([(1, CODE, "k"), (2, None, "k"), (3, "", "k"), (4, "int broken(int a) { call(a", "k")], "request_id bigint, snippet string, kind string")
    rows = C.extract(df).collect()
    of = lambda kind, i=1: {(r.function, r.symbol, r.arguments) for r in rows if r.kind == kind and r.request_id == i}
    assert of("function") == {("helper", "helper", 2), ("Box::fill", "Box::fill", 0)}
    assert of("call") == {("helper", "mutex_lock", 1), ("helper", "step", 3), ("helper", "mutex_unlock", 1), ("Box::fill", "memcpy", 2), ("Box::fill", "memcpy", 3), ("Box::fill", "helper", 2), ("Box::fill", "helper", 1)}
    assert {(r.kind, r.symbol) for r in rows if "lock" in r.kind} == {("lock", "state.lock"), ("unlock", "state.lock")}
    assert of("return") == {("helper", "a + 1", None)} and of("loop") == {("helper", "while", None)} and ("broken", "broken", 1) in of("function", 4)
    assert {r.line for r in rows if r.kind == "function" and r.request_id == 1} == {3, 12}
    found = C.extract(df)
    assert {(r.function, r.call, r.sink_type) for r in C.sinks(found, SINK_CALLS).collect()} == {("Box::fill", "memcpy", "buffer_overflow")}
    files = df.select("request_id").withColumn("repo", F.lit("r"))
    linked = {(r.caller, r.symbol, r.target_request, r.resolution) for r in C.link(found, files).collect() if r.symbol == "helper"}
    assert linked == {("Box::fill", "helper", 1, "resolved")}


FLOW = """static int leaf(void) { return 1; }
typedef int (*hook)(int);
int table_value = 3;
static struct ops table = { .run = leaf, .stop = &halt };
int declared(int a, int b = 2);
_Noreturn void die(void) { exit(1); }
int user(struct dev *d, int (*cb)(int), char *p)
{
    int (*fp)(int) = 0;
    if (!d || d->ops == NULL)
        return -1;
    use(d);
    if (p != NULL && p[0]) {
        early(p);
        p = next();
        late(p);
    } else {
        otherwise(p);
    }
    fp = flag ? leaf : &outside;
    fp(1);
    cb(2);
    {
        int leaf = 5;
        leaf(3);
    }
    leaf();
    table_value(9);
    while (d->more) { again(d); }
    return 0;
}
void jumps(char *q) {
    if (!q) goto out;
    after(q);
out:
    done(q);
}
"""
OTHER = "int outside(int a) { return a; }\nstatic int hidden(int a) { return a; }\nint twin(int a) { return hidden(a); }\nvoid caller(void) { twin(1); absent(1); user(0, 0, 0); }\n"


def test_c_scopes_links_and_conditions(spark):
    df = spark.createDataFrame([(1, "r", "a.c", FLOW), (2, "r", "b.c", OTHER), (3, "r", "c.c", "int twin(int a, int b) { return 0; }\nint twin2(void) { return hidden(1); }"), (4, "r", "u.h", "int user(struct dev *d, void *cb, char *p);\nint main(void);")], "request_id bigint, repo string, file_path string, snippet string")
    found = C.extract(df).cache()
    rows = found.collect()
    got = {(r.caller, r.symbol, r.line): (r.kind, r.resolution, r.target_request) for r in C.link(found, df).collect() if r.symbol not in ("fp",)}
    assert got["user", "leaf", 25] == ("shadowed", "shadowed", None) and got["user", "leaf", 27] == ("direct", "resolved", 1) and got["user", "table_value", 28] == ("shadowed", "shadowed", None)
    assert got["user", "cb", 22] == ("indirect", "unresolved", None) and got["twin2", "hidden", 2] == ("direct", "unresolved", None) and got["twin", "hidden", 3] == ("direct", "resolved", 2)
    assert got["caller", "twin", 4] == ("direct", "resolved", 2) and got["caller", "absent", 4][1] == "unresolved" and got["caller", "user", 4] == ("direct", "resolved", 1)
    fp = {(r.target, r.target_request, r.resolution) for r in C.link(found, df).collect() if r.symbol == "fp"}
    assert fp == {("leaf", 1, "ambiguous"), ("outside", 2, "ambiguous")}
    of = lambda kind: {(r.function, r.line, r.symbol) for r in rows if r.kind == kind and r.request_id == 1}
    assert {("user", 12, "d"), ("user", 12, "d.ops"), ("user", 14, "p"), ("user", 29, "d.more")} <= of("nonnull") and ("user", 16, "p") not in of("nonnull")
    assert ("jumps", 34, "q") not in of("nonnull") and not [x for x in of("null") if x[1] == 18]
    assert {(r.symbol, r.detail) for r in rows if r.kind == "condition" and r.line == 12} == {("!d||d.ops==NULL", "guard false")}
    assert {x[2] for x in of("initialiser")} == {"leaf", "halt"} and {x[2] for x in of("global")} >= {"table_value", "table"} and {x[2] for x in of("noreturn")} == {"die"}
    assert {(r.symbol, r.arguments) for r in rows if r.kind == "declaration" and r.request_id == 1} == {("declared", 1)}
    assert {(r.name, r.file_path) for r in C.public_declarations(found, df).collect()} == {("user", "u.h"), ("main", "u.h")}
    assert {(r.request_id, r.function) for r in C.entry_points(found, df).collect()} == {(1, "user"), (1, "leaf")}
    assert {r.id for r in C.functions_of(found, df).where("request_id = 2").collect()} == {"b.c::outside", "b.c::hidden", "b.c::twin", "b.c::caller"}
    spans = spark.createDataFrame([(1, "user", "p", 0, 10_000), (1, "user", "zz", 0, 10)], "request_id bigint, function string, path string, from_byte int, to_byte int")
    assert {r.path: r.modified for r in C.modified_between(found, spans).collect()} == {"p": True, "zz": False}


def test_null_facts():
    N = W.null_facts
    assert N("p", True) == {("p", False)} and N("!p", True) == {("p", True)} and N("p==NULL||q", False) == {("p", False), ("q", True)}
    assert N("p&&!q.r", True) == {("p", False), ("q.r", True)} and N("p&&q", False) == set() and N("p||p", True) == {("p", False)}
    assert N("(NULL!=(p))", True) == {("p", False)} and N("f(p)", True) == set() and N("a<b", True) == set() and N("!(p||q)", True) == {("p", True), ("q", True)}
    assert W.choices("(c ? f : &g)") == ["f", "g"] and W.choices("a + b") == [] and W.folded("a -> b [ 1 ]  &  c :: d") == "a.b[1]&c::d"
