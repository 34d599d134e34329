"""Keyed records, graph revisions and checkpoints as tables: look-ups, deletions, refreshes, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from .retrieval import namespace_matches, stale


def fetched(records: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The records of the keys asked for, once each; keys without a record have no row, null keys none."""
    return records.join(keys.select(*on).distinct(), on, "left_semi")


def deleted(records: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The records without those of the keys; keys without a record change nothing."""
    return records.join(keys.select(*on).distinct(), on, "left_anti")


def without_stale(records: DataFrame, wanted: dict[str, str], key: str) -> DataFrame:
    """The records that `stale` doesn't name; without criteria all of them."""
    return records.join(stale(records, wanted).select(key), key, "left_anti")


def namespaces(records: DataFrame, depth: int | None = None) -> DataFrame:
    """The distinct namespaces (arrays), cut at a depth."""
    ns = F.col("namespace")
    return records.where(ns.isNotNull()).select((F.slice(ns, 1, depth) if depth else ns).alias("namespace")).distinct()


def refreshed(old: DataFrame, fresh: dict[tuple[str, ...], DataFrame]) -> DataFrame:
    """Several namespaces replaced at once: everything under each prefix gives way to its fresh rows (namespace, key, value)."""
    kept = old
    for prefix in fresh:
        kept = kept.where(~namespace_matches(F.col("namespace"), prefix=list(prefix)))
    for prefix, rows in fresh.items():
        inside = namespace_matches(F.col("namespace"), prefix=list(prefix))
        kept = kept.unionByName(rows.withColumn("key", F.when(inside, F.col("key")).otherwise(F.raise_error(F.lit("row outside the prefix")))))
    return kept


def in_pages(spark: SparkSession, ordered: DataFrame, order: list[str], size: int) -> DataFrame:
    """ordered with `page` and `place`: pages of a listing from 0, without sorting it in one task.

    Range partitions are sorted and counted; a row's place is its place in its partition and the rows of the partitions before.
    """
    placed = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    placed = Scratch(spark).write(placed.withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)))
    from pyspark.sql import Window

    n = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    place = F.col("before") + F.col("at")
    return placed.join(F.broadcast(n.select("part", "before")), "part").select(*ordered.columns, place.alias("place"), F.floor(place / size).alias("page"))


def manifests(records: DataFrame) -> DataFrame:
    """repo, graph_revision, records, kinds, complete, fingerprint, latest: what each stored revision of a graph holds.

    Repeated rows of a position count once. A revision is complete if its positions have no gap. The fingerprint is a sum of row
    hashes, so it needs no order and no row that holds a whole graph; equal contents have equal ones, whatever their revision.
    """
    once = records.dropDuplicates(["graph_revision", "position"])
    row = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", "kind", "identity", F.coalesce("payload", F.lit(""))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    g = once.groupBy("repo", "graph_revision").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("kind").alias("kinds"), F.min("position").alias("a"), F.max("position").alias("z"), F.sum(row).cast("string").alias("fingerprint"))
    last = records.groupBy("repo").agg(F.max("graph_revision").alias("last"))
    done = (F.col("z") - F.col("a") + 1) == F.col("records")
    return g.join(last, "repo").select("repo", "graph_revision", "records", "kinds", done.alias("complete"), "fingerprint", (F.col("graph_revision") == F.col("last")).alias("latest"))


def rebuild_plan(stored: DataFrame, current: DataFrame, failed: DataFrame) -> DataFrame:
    """repo, action: `reuse` where the stored fingerprint (repo, fingerprint) equals the current one and no file failed, else `build`. One row for each current repo."""
    bad = failed.select("repo").distinct().withColumn("bad", F.lit(True))
    met = current.select("repo", F.col("fingerprint").alias("now")).join(stored.select("repo", F.col("fingerprint").alias("was")), "repo", "left").join(bad, "repo", "left")
    return met.select("repo", F.when((F.col("now") == F.col("was")) & F.col("bad").isNull(), "reuse").otherwise("build").alias("action"))


def checkpoint_key(*parts):
    """A column that is the hash of every input of an answer; null parts differ from empty ones."""
    return F.sha2(F.to_json(F.struct(*(F.col(p).cast("string").alias(p) for p in parts)), {"ignoreNullFields": "false"}), 256)


def remaining(work: DataFrame, checkpoints: DataFrame, key: str, version: int) -> DataFrame:
    """The work whose key no checkpoint of this version has answered; rows whose answer isn't whole JSON count as unanswered."""
    done = checkpoints.where((F.col("version") == version) & F.try_parse_json("answer").isNotNull()).select(key).distinct()
    return work.join(done, key, "left_anti")
