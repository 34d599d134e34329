import random

import pytest

from seamquarry.operators import hierarchy as H

SCHEMA = "record string, run_id string, span_id string, parent_span_id string, path string"


def brute_circular(edges):
    up = {}
    for r, s, p in edges:
        up.setdefault((r, s), set()).add((r, p))
    out = set()
    for start in up:
        seen, todo = set(), list(up[start])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += up.get(n, ())
        if start in seen:
            out.add(start)
    return out


def forest(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        run = f"r{rng.randrange(2)}"
        parent = rng.choice([None, "", f"s{rng.randrange(n)}", f"s{max(0, i - 1)}", "nobody"])
        rows.append(("span.start", run, f"s{i}", parent, "x"))
        rows.append(("span.end", run, f"s{i}", rng.choice([None, parent]), "y"))
    rows += [("event", "r0", "s1", "s1", "z"), ("span.start", None, "a", "a", "z"), ("span.start", "r0", None, "a", "z"), ("span.start", "r0", "", "a", "z"), ("span.start", "r1", "self", "self", "z")]
    return rows + rows[:10]


@pytest.mark.parametrize("core_rows", [10**6, 3])
def test_circles_match_brute_force(spark, core_rows):
    rows = forest(5)
    df = spark.createDataFrame(rows, SCHEMA)
    edges = {(r, s, p) for rec, r, s, p, _ in rows if rec != "event" and r and s and p}
    got = {tuple(x) for x in H.circular_spans(spark, H.span_edges(df), core_rows).collect()}
    assert got == brute_circular(edges) and ("r1", "self") in got


def test_two_parents_between_circles(spark):
    # c sits between two circles and above neither: it is its own ancestor of nothing
    e = [("r", "a", "b"), ("r", "b", "a"), ("r", "c", "a"), ("r", "x", "c"), ("r", "y", "x"), ("r", "x", "y")]
    df = spark.createDataFrame(e, "run_id string, span_id string, parent string")
    want = brute_circular(e)
    assert {tuple(x) for x in H.circular_spans(spark, df).collect()} == want == {("r", k) for k in "abxy"}
    assert {tuple(x) for x in H.circular_spans(spark, df, core_rows=0).collect()} == want


@pytest.mark.parametrize("core_rows", [10**6, 5])
def test_paths_depths_and_sizes(spark, core_rows):
    rows = forest(9)
    nodes = {}
    for rec, r, s, p, _ in rows:
        if rec != "event" and r and s:
            nodes.setdefault((r, s), set()).add(p or None)
    parent = {k: min((p for p in v if p), default=None) for k, v in nodes.items()}
    parent = {k: p if (k[0], p) in nodes else None for k, p in parent.items()}

    def path(k):
        out, seen = [k[1]], {k}
        while parent[k] is not None:
            k = (k[0], parent[k])
            if k in seen:
                return None
            seen.add(k)
            out.append(k[1])
        return out[::-1]

    tree = H.hierarchy(spark, H.span_nodes(spark.createDataFrame(rows, SCHEMA)), core_rows).cache()
    got = {(r.run_id, r.span_id): r for r in tree.collect()}
    paths = {k: path(k) for k in nodes}
    assert set(got) == set(nodes)
    for k, p in paths.items():
        r = got[k]
        if p is None:
            assert r.unrooted and r.path is None and r.subtree is None
        else:
            assert (r.path, r.depth, r.root) == (p, len(p) - 1, p[0])
            assert r.subtree == sum(1 for q in paths if q[0] == k[0] and paths[q] and k[1] in paths[q])
    below = {(r.run_id, r.span_id, r.descendant, r.hops) for r in H.descendants(tree).collect()}
    assert below == {(k[0], a, k[1], len(p) - 1 - i) for k, p in paths.items() if p for i, a in enumerate(p[:-1])}


@pytest.mark.parametrize("core_rows", [10**6, 4])
def test_long_chains_circles_and_slashes(spark, core_rows):
    parent = {f"c{i}": f"c{i - 1}" if i else None for i in range(70)} | {"a/b": None, "a": None, "k/": "a/b", "x": "y", "y": "x", "z": "x"}
    df = spark.createDataFrame([("r", k, p) for k, p in parent.items()], "run_id string, span_id string, parent string")
    tree = H.hierarchy(spark, df, core_rows)
    got = {r.span_id: r for r in tree.collect()}
    assert got["c69"].path == [f"c{i}" for i in range(70)] and got["c69"].depth == 69 and [got[f"c{i}"].subtree for i in (0, 69)] == [70, 1]
    assert got["k/"].path == ["a/b", "k/"] and got["a"].subtree == 1 and all(got[k].unrooted for k in "xyz")
    below = {(r.span_id, r.descendant) for r in H.descendants(tree).collect()}
    assert ("a/b", "k/") in below and ("a", "k/") not in below and len(below) == 70 * 69 // 2 + 1


def test_large_knots(spark):
    e = [("r", f"k{i}", f"k{(i + 1) % 9}") for i in range(9)] + [("r", "k3", "k7"), ("r", "m", "k1"), ("r", "m", "m"), ("r", "k0", "p"), ("r", "p", "q"), ("r", "q", "p"), ("s", "k1", "k2")]
    df = spark.createDataFrame(e, "run_id string, span_id string, parent string")
    assert {tuple(x) for x in H.circular_spans(spark, df, core_rows=1).collect()} == brute_circular(e)


def test_one_rule_for_several_parents(spark):
    rows = [("span.start", "r", "a", "b", ""), ("span.end", "r", "a", "z", ""), ("span.start", "r", "b", "c", ""), ("span.start", "r", "z", "a", ""), ("span.start", "r", "c", None, ""), ("span.start", "r", "d", "c", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    loops = {x.span_id for x in H.circular_spans(spark, H.span_edges(df)).collect()}
    got = {r.span_id: r.unrooted for r in H.run_hierarchy(spark, df).collect()}
    assert loops == {"a", "z"} and got == {"a": True, "z": True, "b": False, "c": False, "d": False}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert H.circular_spans(spark, H.span_edges(none)).count() == 0
    assert H.hierarchy(spark, H.span_nodes(none)).count() == 0
