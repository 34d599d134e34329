"""Parent-child rows to full hierarchies by leaf peeling.

Bottom-up, every round takes off the nodes that no remaining row names as parent and sends their subtree sizes to their
parents; in reverse peel order each batch then gets its paths from parents that were peeled later. What peeling from both
ends cannot remove holds the cycles.

Rounds are distributed joins while they pay. A remainder of at most CORE_ROWS edges, which is counted first, is peeled on in
one task. A larger remainder of which a round takes off less than a tenth, long thin chains, is finished by doubling pointers,
so the rounds grow as the logarithm of the depth and of the rows. Paths are arrays, so ids may hold any character.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from .graph import components

#: Edges that one task may hold (about 30 MB); above it peeling stays distributed, so this bounds memory and drops nothing.
CORE_ROWS = 200_000


def span_nodes(log: DataFrame) -> DataFrame:
    """run_id, span_id, parent: one row for each span.start/span.end row's span, with the parent that either row names.

    Null or empty parents count as none; of several different parents the least is kept here (`span_edges` keeps all).
    Rows without run_id or span_id describe no span.
    """
    rows = log.where(F.col("record").isin("span.start", "span.end") & F.col("run_id").isNotNull() & (F.coalesce(F.col("span_id"), F.lit("")) != ""))
    return rows.groupBy("run_id", "span_id").agg(F.min(F.when(F.col("parent_span_id") != "", F.col("parent_span_id"))).alias("parent"))


def span_edges(log: DataFrame) -> DataFrame:
    """run_id, span_id, parent: each distinct non-empty link that a span.start or span.end row states."""
    return (
        log.where(F.col("record").isin("span.start", "span.end") & F.col("run_id").isNotNull() & (F.coalesce(F.col("span_id"), F.lit("")) != "") & (F.col("parent_span_id") != ""))
        .select("run_id", "span_id", F.col("parent_span_id").alias("parent"))
        .distinct()
    )


def _peel_once(e: DataFrame) -> DataFrame:
    """The edges whose lower end has a child and whose upper end has a parent."""
    parents = e.select("run_id", F.col("parent").alias("span_id")).distinct()
    children = e.select("run_id", F.col("span_id").alias("parent")).distinct()
    return e.join(parents, ["run_id", "span_id"], "left_semi").join(children, ["run_id", "parent"], "left_semi").select("run_id", "span_id", "parent")


def _circular(edges: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """The nodes that reach themselves: strongly connected parts by an iterative depth-first search."""
    up: dict[tuple[str, str], list[tuple[str, str]]] = defaultdict(list)
    for run, a, b in edges:
        up[run, a].append((run, b))
    index: dict = {}
    low: dict = {}
    on: set = set()
    stack: list = []
    out = []
    for start in list(up):
        if start in index:
            continue
        work = [(start, iter(up[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(up.get(nxt, ()))))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part.append(x)
                        if x == node:
                            break
                    if len(part) > 1 or node in up.get(node, ()):
                        out += part
    return out


def _peel_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In one task: peel a bounded remainder from both ends to its end, then keep the nodes on a circle."""
    got = [b for b in batches if len(b)]
    edges = set(pd.concat(got)[["run_id", "span_id", "parent"]].itertuples(index=False, name=None)) if got else set()
    while edges:
        below, above = {(r, p) for r, _, p in edges}, {(r, s) for r, s, _ in edges}
        kept = {x for x in edges if (x[0], x[1]) in below and (x[0], x[2]) in above}
        if len(kept) == len(edges):
            break
        edges = kept
    yield pd.DataFrame(_circular(sorted(edges)), columns=["run_id", "span_id"], dtype=object)


def circular_spans(spark: SparkSession, edges: DataFrame, core_rows: int = CORE_ROWS) -> DataFrame:
    """run_id, span_id of each span that is its own ancestor (run_id, span_id, parent given, all strings).

    An empty table gives none. Extra columns are ignored. Peeling ends when a round removes nothing; if what is then left
    exceeds `core_rows`, it falls into its components, which are searched side by side.
    """
    tmp = Scratch(spark)
    now = tmp.write(edges.select("run_id", "span_id", "parent"))
    count = now.count()
    while count > core_rows:
        now, left = _trimmed(tmp, now)
        if left == count:
            return _by_component(spark, tmp, now, core_rows)
        count = left
    return now.coalesce(1).mapInPandas(_peel_rest, "run_id string, span_id string").distinct()


def _trimmed(tmp: Scratch, e: DataFrame) -> tuple[DataFrame, int]:
    out = tmp.write(_peel_once(e))
    n = out.count()
    tmp.drop(e)
    return out, n


def _by_component(spark: SparkSession, tmp: Scratch, e: DataFrame, core_rows: int) -> DataFrame:
    """For a remainder too large for one task, peeled from both ends.

    A component of at most core_rows edges is one group. In a larger one in which each node names one parent, all nodes are
    circular, as no end is left. What then remains, large knots of several parents, is coloured.
    """
    key = lambda c: F.concat(F.length("run_id"), F.lit(":"), "run_id", c)
    pairs = e.select(key("span_id").alias("a"), key("parent").alias("b"))
    comp = tmp.write(components(spark, pairs.select(F.col("a").alias("id")), pairs, core_rows))
    placed = tmp.write(e.withColumn("id", key("span_id")).join(comp, "id").select("run_id", "span_id", "parent", "component"))
    per = placed.groupBy("component", "run_id", "span_id").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.sum("n").alias("edges"), F.max("n").alias("most"))
    placed = placed.join(per, "component")
    small = placed.where(F.col("edges") <= core_rows).groupBy("component").applyInPandas(lambda b: next(_peel_rest(iter([b]))), "run_id string, span_id string")
    rings = placed.where((F.col("edges") > core_rows) & (F.col("most") == 1)).select("run_id", "span_id")
    knots = tmp.write(placed.where((F.col("edges") > core_rows) & (F.col("most") > 1)).select("run_id", "span_id", "parent"))
    return small.unionByName(rings).unionByName(_knots(tmp, knots)).distinct()


def _spread(tmp: Scratch, e: DataFrame, colour: DataFrame) -> DataFrame:
    """colour (run_id, span_id, c) with the greatest c of all nodes from which a node is reached along the edges."""
    last = None
    while True:
        sent = e.join(colour, ["run_id", "span_id"]).select("run_id", F.col("parent").alias("span_id"), "c")
        new = tmp.write(colour.unionByName(sent).groupBy("run_id", "span_id").agg(F.max("c").alias("c")))
        mark = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("run_id", "span_id", "c").cast("decimal(38,0)"))).first())
        if mark == last:
            return new
        colour, last = new, mark


def _knots(tmp: Scratch, e: DataFrame) -> DataFrame:
    """run_id, span_id of nodes on circles, by colouring: each colour's greatest node and those of its colour that it is reached from and reaches are a knot."""
    found = e.select("run_id", "span_id").limit(0)
    count = e.count()
    while count:
        colour = _spread(tmp, e, e.select("run_id", "span_id", F.col("span_id").alias("c")).distinct())
        inner = e.join(colour, ["run_id", "span_id"]).join(colour.select("run_id", F.col("span_id").alias("parent"), F.col("c").alias("pc")), ["run_id", "parent"]).where("c = pc")
        back = tmp.write(inner.select("run_id", F.col("parent").alias("span_id"), F.col("span_id").alias("parent")))
        heads = colour.where("span_id = c")
        reached = _spread(tmp, back, heads.select("run_id", "span_id", "c"))
        whole = reached.groupBy("run_id", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("run_id", "c")
        selves = e.where("span_id = parent").select("run_id", "span_id")
        found = found.unionByName(reached.join(whole, ["run_id", "c"], "left_semi").select("run_id", "span_id")).unionByName(reached.select("run_id", "span_id").join(selves, ["run_id", "span_id"], "left_semi"))
        gone = reached.select("run_id", "span_id")
        e = e.join(gone, ["run_id", "span_id"], "left_anti").join(gone.withColumnRenamed("span_id", "parent"), ["run_id", "parent"], "left_anti")
        e = tmp.write(e.select("run_id", "span_id", "parent"))
        count = e.count()
    return found


def _solve_core(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In one task: paths, depths, roots and subtree sizes of a bounded remainder; nodes on or below a circle get none."""
    got = [b for b in batches if len(b)]
    names = ["run_id", "span_id", "parent", "path", "depth", "root", "subtree"]
    rows = list(pd.concat(got)[["run_id", "span_id", "parent", "acc"]].itertuples(index=False, name=None)) if got else []
    parent = {(r, s): p for r, s, p, _ in rows}
    kids: dict = defaultdict(list)
    for (r, s), p in parent.items():
        if p is not None and (r, p) in parent:
            kids[r, p].append((r, s))
    roots = [(k, 0) for k, p in parent.items() if p is None or (k[0], p) not in parent]
    size = {(r, s): int(a) for r, s, _, a in rows}
    order, at = [k for k, _ in roots], 0
    while at < len(order):
        order += kids[order[at]]
        at += 1
    for k in reversed(order):
        for c in kids[k]:
            size[k] += size[c]
    rooted, out, held, path = set(order), [], 0, []
    todo = roots[::-1]
    while todo:
        k, depth = todo.pop()
        path = [*path[:depth], k[1]]
        out.append((*k, parent[k], path, depth, path[0], size[k]))
        held += depth + 1
        if held > 1_000_000:  # long paths go out before they fill the memory
            yield pd.DataFrame(out, columns=names)
            out, held = [], 0
        todo += [(c, depth + 1) for c in kids[k]]
    out += [(*k, p, None, None, None, None) for k, p in parent.items() if k not in rooted]
    yield pd.DataFrame(out, columns=names).astype({"depth": "Int64", "subtree": "Int64"})


_SHAPE = "run_id string, span_id string, parent string, path array<string>, depth bigint, root string, subtree bigint"


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _doubled(tmp: Scratch, nodes: DataFrame) -> DataFrame:
    """_SHAPE of nodes (run_id, span_id, parent, acc) in rounds that grow as the logarithm of the depth.

    First pointers alone: each jumps as far as the one it points to. A round in which no pointer comes to a root leaves those on
    or below circles. The others' paths then grow in the same way, from the node up.
    """
    ends = [tmp.write(nodes.where("parent is null").select("run_id", "span_id", F.lit(None).cast("string").alias("up")))]
    now = tmp.write(nodes.where("parent is not null").select("run_id", "span_id", F.col("parent").alias("up")))
    while True:
        look = _union([*ends, now]).select("run_id", F.col("span_id").alias("up"), F.col("up").alias("next"))
        new = tmp.write(now.join(look, ["run_id", "up"]).select("run_id", "span_id", F.col("next").alias("up")))
        ends.append(new.where("up is null"))
        now = new.where("up is not null")
        if ends[-1].isEmpty():
            break
    lost = now.select("run_id", "span_id")
    paths = [tmp.write(nodes.where("parent is null").select("run_id", "span_id", F.lit(None).cast("string").alias("up"), F.array("span_id").alias("path")))]
    now = nodes.where("parent is not null").join(lost, ["run_id", "span_id"], "left_anti").select("run_id", "span_id", F.col("parent").alias("up"), F.array("span_id").alias("path"))
    now = tmp.write(now)
    while not now.isEmpty():
        look = _union([*paths, now]).select("run_id", F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        new = tmp.write(now.join(look, ["run_id", "up"]).select("run_id", "span_id", F.col("next").alias("up"), F.concat("above", "path").alias("path")))
        paths.append(new.where("up is null"))
        now = new.where("up is not null")
    whole = _union(paths).select("run_id", "span_id", "path").join(nodes, ["run_id", "span_id"])
    subtree = whole.select("run_id", F.explode("path").alias("span_id"), "acc").groupBy("run_id", "span_id").agg(F.sum("acc").alias("subtree"))
    rooted = whole.join(subtree, ["run_id", "span_id"]).select("run_id", "span_id", "parent", "path", (F.size("path") - 1).cast("bigint").alias("depth"), F.col("path")[0].alias("root"), "subtree")
    nothing = (F.lit(None).cast(t).alias(c) for c, t in (("path", "array<string>"), ("depth", "bigint"), ("root", "string"), ("subtree", "bigint")))
    return tmp.write(rooted.unionByName(nodes.join(lost, ["run_id", "span_id"], "left_semi").select("run_id", "span_id", "parent", *nothing)))


def hierarchy(spark: SparkSession, nodes: DataFrame, core_rows: int = CORE_ROWS) -> DataFrame:
    """run_id, span_id, parent, path, depth, root, subtree (its own node counted), unrooted.

    `nodes` has run_id, span_id (unique together) and parent (null: a root). A parent that no node describes makes its child
    a root. Nodes on or below a circle have a null path, depth and root, and unrooted true; their subtree size is null too.
    The path is the array of ids from the root down. An empty table gives no rows.
    """
    tmp = Scratch(spark)
    base = nodes.select("run_id", "span_id", "parent")
    known = base.select("run_id", F.col("span_id").alias("parent"), F.lit(True).alias("known"))
    linked = base.join(known, ["run_id", "parent"], "left").select("run_id", "span_id", F.when(F.col("known"), F.col("parent")).alias("parent"))
    now = tmp.write(linked.withColumn("acc", F.lit(1).cast("bigint")))
    batches: list[DataFrame] = []
    count, left = now.count(), 0
    while count > core_rows and left < 0.9 * count:
        count = left or count
        inner = now.where("parent is not null").select("run_id", F.col("parent").alias("span_id")).distinct().withColumn("inner", F.lit(True))
        marked = tmp.write(now.join(inner, ["run_id", "span_id"], "left"))
        tmp.drop(now)
        leaves = marked.where("inner is null").select("run_id", "span_id", "parent", "acc")
        sent = leaves.where("parent is not null").groupBy("run_id", F.col("parent").alias("span_id")).agg(F.sum("acc").alias("got"))
        rest = marked.where("inner").select("run_id", "span_id", "parent", "acc").join(sent, ["run_id", "span_id"], "left")
        now = tmp.write(rest.select("run_id", "span_id", "parent", (F.col("acc") + F.coalesce("got", F.lit(0))).alias("acc")))
        batches.append(leaves)
        left = now.count()
        if left <= core_rows:
            count = left
    done = [tmp.write(now.coalesce(1).mapInPandas(_solve_core, _SHAPE)) if count <= core_rows else _doubled(tmp, now)]
    for leaves in reversed(batches):
        above = _union(done).select("run_id", F.col("span_id").alias("parent"), *(F.col(c).alias(f"up_{c}") for c in ("path", "depth", "root")))
        solo = F.col("parent").isNull()
        put = leaves.join(above, ["run_id", "parent"], "left").select(
            "run_id", "span_id", "parent",
            F.when(solo, F.array("span_id")).otherwise(F.concat("up_path", F.array("span_id"))).alias("path"),
            F.when(solo, F.lit(0).cast("bigint")).otherwise(F.col("up_depth") + 1).alias("depth"),
            F.when(solo, F.col("span_id")).otherwise(F.col("up_root")).alias("root"),
            F.when(solo | F.col("up_path").isNotNull(), F.col("acc")).alias("subtree"),
        )
        done.append(tmp.write(put))
    return _union(done).withColumn("unrooted", F.col("path").isNull())


def run_hierarchy(spark: SparkSession, log: DataFrame, core_rows: int = CORE_ROWS) -> DataFrame:
    """`hierarchy` of a log's spans, by the same links as `circular_spans`: a span that is its own ancestor by any parent that its
    rows state is unrooted, and what is below it too; another span with several parents hangs below the least of them."""
    nodes, edges = span_nodes(log), span_edges(log)
    if edges.groupBy("run_id", "span_id").count().where("count > 1").isEmpty():
        return hierarchy(spark, nodes, core_rows)
    loops = circular_spans(spark, edges, core_rows).withColumn("loop", F.lit(True))
    parent = F.when(F.col("loop"), F.col("span_id")).otherwise(F.col("parent"))
    return hierarchy(spark, nodes.join(loops, ["run_id", "span_id"], "left").select("run_id", "span_id", parent.alias("parent")), core_rows)


def descendants(tree: DataFrame) -> DataFrame:
    """run_id, span_id, descendant, hops: one row for each node and each node below it, from the paths of `hierarchy`.

    A row per link rather than a list per node: a root above a third of all rows would need that list in one cell.
    """
    return (
        tree.where("path is not null")
        .select("run_id", F.col("span_id").alias("descendant"), F.col("depth").alias("own"), F.posexplode("path").alias("at", "span_id"))
        .where("at < own")
        .select("run_id", "span_id", "descendant", (F.col("own") - F.col("at")).alias("hops"))
    )
