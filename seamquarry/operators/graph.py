"""Call graphs and the walks over them, as edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Steps of a walk in one job.
LEVELS = 4
#: Edges that one task may join up (a few MB); above it the rounds are distributed.
CORE_ROWS = 200_000
NODE = "struct<unique_name:string,file_path:string,name:string,line_number:int,calls:array<string>,is_source:boolean,is_sink:boolean>"


def latest_revision(records: DataFrame) -> DataFrame:
    """The records of each repository's last revision. Repeated rows of a position count once."""
    last = records.groupBy("repo").agg(F.max("graph_revision").alias("graph_revision"))
    return records.join(last, ["repo", "graph_revision"], "left_semi").dropDuplicates(["graph_revision", "position"])


def nodes(records: DataFrame) -> DataFrame:
    """repo, id, file_path, name, line, calls, is_source, is_sink from node records; payloads that aren't whole JSON give nulls but the id."""
    n = records.where("kind = 'node'").select("repo", F.col("identity").alias("id"), F.from_json("payload", NODE).alias("n"))
    return n.select("repo", "id", "n.file_path", "n.name", F.col("n.line_number").alias("line"), "n.calls", "n.is_source", "n.is_sink")


def resolve_calls(n: DataFrame) -> DataFrame:
    """repo, caller, symbol, callee, resolution: each call's targets by name; those in the caller's own file hide the others.

    One equi-join on repository and name. Several targets are all kept (ambiguous). Calls to no known name have a null callee (unresolved).
    """
    calls = n.select("repo", F.col("id").alias("caller"), F.col("file_path").alias("from_file"), F.explode(F.array_distinct("calls")).alias("symbol"))
    targets = n.select("repo", F.col("name").alias("symbol"), F.col("id").alias("callee"), F.col("file_path").alias("to_file"))
    met = calls.join(targets, ["repo", "symbol"], "left").withColumn("near", F.coalesce((F.col("from_file") == F.col("to_file")).cast("int"), F.lit(0)))
    w = Window.partitionBy("repo", "caller", "symbol")
    kept = met.withColumn("best", F.max("near").over(w)).where("near = best").withColumn("n", F.count("callee").over(w))
    return kept.select("repo", "caller", "symbol", "callee", F.when(F.col("n") == 0, "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("resolution"))


def edges(calls: DataFrame) -> DataFrame:
    """repo, src, dst of resolved calls."""
    return calls.where("callee is not null").select("repo", F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()


def reverse_edges(e: DataFrame) -> DataFrame:
    """repo, dst, callers (sorted), n_callers. A hub's list is as long as its callers are many; take the edges where that has no bound."""
    return e.groupBy("repo", "dst").agg(F.array_sort(F.collect_set("src")).alias("callers")).withColumn("n_callers", F.size("callers"))


def automatic_sources(n: DataFrame, e: DataFrame) -> DataFrame:
    """repo, id of nodes that no other node calls."""
    called = e.where("src <> dst").select("repo", F.col("dst").alias("id")).distinct()
    return n.select("repo", "id").join(called, ["repo", "id"], "left_anti")


def external_sinks(calls: DataFrame, table: dict[str, str]) -> DataFrame:
    """repo, id, call, sink_type: nodes that call a sensitive outside function that no node defines; the first by name decides."""
    kinds = calls.sparkSession.createDataFrame([(c, k) for k, cs in table.items() for c in cs.split()], "call string, sink_type string")
    met = calls.where("callee is null").select("repo", F.col("caller").alias("id"), F.lower("symbol").alias("call")).join(kinds, "call")
    return met.groupBy("repo", "id").agg(F.min(F.struct("call", "sink_type")).alias("m")).select("repo", "id", "m.call", "m.sink_type")


def shortest_routes(spark: SparkSession, e: DataFrame, starts: DataFrame, goals: DataFrame, most_nodes: int = 25) -> DataFrame:
    """repo, start, goal, path, hops: a shortest route from each start to each goal that it reaches, a node at most once.

    Breadth first, LEVELS steps in one job: each step is a join with the edges and an aggregate to the least route for each
    node; what was reached before is anti-joined at the end of the job and the new frontier written to the shared folder. Of
    several routes of equal length the least is taken. Nodes more than `most_nodes` away cannot be on a route that counts, so the
    walk ends there. A start that is a goal has a route of one node.
    """
    tmp = Scratch(spark)
    near = e.select("repo", F.col("src").alias("node"), "dst")
    least = F.min(F.struct(F.size("path").alias("n"), "path")).alias("b")
    front = tmp.write(starts.select("repo", F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path")).distinct())
    edge_table = tmp.write(near)
    reached, done, size = front, 1, front.count()
    while size and done < most_nodes:
        steps, step = [], front
        for _ in range(min(LEVELS, most_nodes - done)):
            step = step.join(edge_table, ["repo", "node"]).where(~F.array_contains("path", F.col("dst"))).select("repo", "start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
            step = step.groupBy("repo", "start", "node").agg(least).select("repo", "start", "node", "b.path")
            steps.append(step)
            done += 1
        found = steps[0]
        for more in steps[1:]:
            found = found.unionByName(more)
        best = found.groupBy("repo", "start", "node").agg(least).select("repo", "start", "node", "b.path")
        new = tmp.write(best.join(reached.select("repo", "start", "node"), ["repo", "start", "node"], "left_anti"))
        reached = reached.unionByName(new)
        front = new.where(F.size("path") == done)
        size = front.count()
    out = reached.join(goals.select("repo", F.col("id").alias("node")).distinct(), ["repo", "node"], "left_semi")
    return out.select("repo", "start", F.col("node").alias("goal"), "path", (F.size("path") - 1).alias("hops"))


def _union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In one task: the least id of each component of a bounded number of edges."""
    lead: dict = {}

    def find(x):
        top = x
        while lead.setdefault(top, top) != top:
            top = lead[top]
        while lead[x] != top:
            lead[x], x = top, lead[x]
        return top

    for b in batches:
        for x, y in zip(b["a"].tolist(), b["b"].tolist()):
            x, y = find(x), find(y)
            if x != y:
                lead[max(x, y)] = min(x, y)
    yield pd.DataFrame({"id": list(lead), "component": [find(x) for x in lead]})


def components(spark: SparkSession, vertices: DataFrame, pairs: DataFrame, core_rows: int = CORE_ROWS) -> DataFrame:
    """id, component (its least id) over undirected pairs (a, b); vertices without pairs are alone.

    Alternating large-star and small-star rounds: neighbours move to the least one around, and a hub's neighbours are spread over the
    stars of smaller nodes, so the rounds grow as the logarithm of the longest chain and no group is gathered in one row. At most
    `core_rows` edges, which are counted first, are joined up in one task instead, where rounds would cost more than the work.
    """
    tmp = Scratch(spark)
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    e = tmp.write(pairs.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    if e.count() <= core_rows:
        kind = dict(e.dtypes)["a"]
        lead = e.coalesce(1).mapInPandas(_union, f"id {kind}, component {kind}")
        return vertices.select("id").distinct().join(lead, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    while True:
        l = both(e)
        least = l.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tmp.write(l.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b")
        new = tmp.write(small.distinct())
        mark = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        e = new
        if mark == seen:
            break
        seen = mark
    lead = e.groupBy("a").agg(F.min("b").alias("component"))
    return vertices.select("id").distinct().join(lead.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def induced(n: DataFrame, e: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes to keep (repo, id) and the edges among them."""
    k = keep.select("repo", "id").distinct()
    inner = e.join(k.withColumnRenamed("id", "src"), ["repo", "src"], "left_semi").join(k.withColumnRenamed("id", "dst"), ["repo", "dst"], "left_semi")
    return n.join(k, ["repo", "id"], "left_semi"), inner


def enclosing(spans: DataFrame, places: DataFrame) -> DataFrame:
    """place_id, id: the innermost span that holds each place: equi-join on repo and file, then the range; the latest start wins, of equal ones the least id.

    spans: repo, file, id, start_line, end_line. places: place_id, repo, file, line. Places in no span are left out.
    """
    met = places.join(spans, ["repo", "file"]).where("line between start_line and end_line")
    best = met.groupBy("place_id").agg(F.max(F.struct("start_line", F.lit(0))).alias("top"))
    return met.join(best, "place_id").where("start_line = top.start_line").groupBy("place_id").agg(F.min("id").alias("id"))


def diverse(paths: DataFrame, group: str, boundary: str, order: list[str], per_boundary: int, per_group: int, total: int) -> DataFrame:
    """A round-robin choice: inside a group by turns over its boundaries, then by turns over the groups, each with a cap; pick numbers the chosen rows.

    `order` ranks rows and must be unique. The last limit is the feature itself.
    """
    key = F.struct(*order)
    b = paths.withColumn("variant", F.row_number().over(Window.partitionBy(group, boundary).orderBy(*order))).where(F.col("variant") <= per_boundary)
    b = b.withColumn("lead", F.min(key).over(Window.partitionBy(group, boundary)))
    g = b.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy("variant", "lead"))).where(F.col("turn") <= per_group)
    first = g.withColumn("head", F.min(F.when(F.col("turn") == 1, key)).over(Window.partitionBy(group)))
    top = first.orderBy("turn", "head").limit(total)
    return top.withColumn("pick", F.row_number().over(Window.orderBy("turn", "head"))).drop("variant", "lead", "turn", "head")


def source_paths(spark: SparkSession, e: DataFrame, sources: DataFrame, targets: DataFrame, most_nodes: int = 25) -> DataFrame:
    """repo, target, source, path, hops: for each target (repo, id) the shortest path from a source, of equal ones the least when read from the target.

    The walk goes from the targets, which are fewer, against the edges. A target that is a source has a path of itself; one that
    no source reaches within `most_nodes` nodes has no row.
    """
    turned = e.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))
    routes = shortest_routes(spark, turned, targets.select("repo", "id"), sources.select("repo", "id"), most_nodes)
    best = routes.groupBy("repo", "start").agg(F.min(F.struct("hops", "path", "goal")).alias("b"))
    return best.select("repo", F.col("start").alias("target"), F.col("b.goal").alias("source"), F.reverse("b.path").alias("path"), F.col("b.hops").alias("hops"))


def focus(e: DataFrame, targets: DataFrame, paths: DataFrame) -> DataFrame:
    """repo, id: the targets, the nodes of the paths (repo, path), and who calls a target or is called by one."""
    t = targets.select("repo", "id").distinct()
    called = e.join(t.withColumnRenamed("id", "src"), ["repo", "src"], "left_semi").select("repo", F.col("dst").alias("id"))
    callers = e.join(t.withColumnRenamed("id", "dst"), ["repo", "dst"], "left_semi").select("repo", F.col("src").alias("id"))
    return t.unionByName(paths.select("repo", F.explode("path").alias("id"))).unionByName(called).unionByName(callers).distinct()


def ranked_paths(paths: DataFrame, group: list[str]) -> DataFrame:
    """paths with `rank` in their group: those with a sink first, the more the better, then the shorter, then by file, line, name and path (sinks, file, line, name, path, hops given)."""
    w = Window.partitionBy(*group).orderBy(F.col("sinks").desc(), "hops", "file", "line", "name", "path")
    return paths.withColumn("rank", F.row_number().over(w))


def levels(spark: SparkSession, n: DataFrame, e: DataFrame) -> DataFrame:
    """repo, id, level: a topological order, each node one above the highest of those it follows (edges src before dst). A circle is an error.

    Each round takes off the nodes that nothing left comes before, so the rounds are as many as the levels.
    """
    tmp = Scratch(spark)
    left, rest, out, level = tmp.write(n.select("repo", "id").distinct()), tmp.write(e.select("repo", "src", "dst").distinct()), None, 0
    count = left.count()
    while count:
        free = left.join(rest.select("repo", F.col("dst").alias("id")).distinct(), ["repo", "id"], "left_anti")
        free = tmp.write(free.withColumn("level", F.lit(level)))
        out = free if out is None else out.unionByName(free)
        left = tmp.write(left.join(free.select("repo", "id"), ["repo", "id"], "left_anti"))
        rest = tmp.write(rest.join(free.select("repo", F.col("id").alias("src")), ["repo", "src"], "left_anti"))
        now, level = left.count(), level + 1
        if now == count:
            raise ValueError("the order has a circle")
        count = now
    return out if out is not None else left.withColumn("level", F.lit(0))
