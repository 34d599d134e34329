"""Similarity and text retrieval under a size budget, and keyed stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, blocks: int = 8) -> DataFrame:
    """query_id, vec_id, rank: the k nearest of all vectors by cosine for each stated query, itself left out, ties by id.

    A stated query set against all rows, in blocks: each query meets each block of vectors by an equi-join on the block number, keeps
    that block's k best there, and the blocks' winners are ranked together. Null, empty or zero vectors are near nothing.
    """
    norm = lambda c: F.sqrt(_dot(c, c))
    v = vectors.select(F.col("vec_id"), F.col("embedding").alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).withColumn("nv", norm("v")).where("nv > 0")
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).withColumn("nq", norm("q")).where("nq > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    s = q.join(v, q.block == v.block).where("query_id <> vec_id").select("query_id", v.block, "vec_id", F.round(_dot("q", "v") / (F.col("nq") * F.col("nv")), 9).alias("score"))
    local = s.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "block").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k)
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "vec_id", "rank")


def budgeted(passages: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """group, order, taken, truncated: the passages of each group in order until the budget of characters is used up; the last is cut.

    Blank passages are skipped and cost nothing. Any other takes a character at least, so no group needs more than its first
    `budget` passages: the rank limit goes below the shuffle, and the sums run over no more than that.
    """
    p = passages.select(group, order, F.length(T.stripped(F.col(text))).alias("size")).where("size > 0")
    p = p.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("nth") <= budget)
    before = F.coalesce(F.sum("size").over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = p.withColumn("before", before).where(F.col("before") < budget)
    return p.select(group, order, F.least("size", budget - F.col("before")).alias("taken"), (F.col("size") > budget - F.col("before")).alias("truncated"))


def split_budget(total: Column, docs_share: Column) -> tuple[Column, Column]:
    """(code, docs) characters: the documents' rounded share, half to even, each side at least 1; all to one side at the ends."""
    one = F.greatest(F.lit(1), F.least(F.bround(total * docs_share), total - 1)).cast("bigint")
    docs = F.when((total <= 1) | (docs_share <= 0), 0).when(docs_share >= 1, total).otherwise(one)
    return total - docs, docs


def text_search(records: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key of the records that hold every term of the query; a query without terms finds nothing. An AND of filters, evaluated in the scan's stage."""
    import re

    wanted = sorted({w.lower() for w in re.findall("[A-Za-z0-9_]+", query)})
    if not wanted:
        return records.where(F.lit(False)).select(key)
    may = records
    for w in wanted:  # a cheap test first; the exact one tokenises only what is left
        may = may.where(F.lower(F.col(text)).contains(w))
    return may.where(F.size(F.array_intersect(T.query_terms(F.col(text)), F.array(*map(F.lit, wanted)))) == len(wanted)).select(key)


def json_equals(df: DataFrame, column: str, conditions: dict[str, str]) -> DataFrame:
    """Rows whose JSON holds every value at its dotted path; a missing path is null and equals nothing."""
    out = df
    for path, want in conditions.items():
        out = out.where(F.get_json_object(column, f"$.{path}") == want)
    return out


def namespace_matches(ns: Column, prefix: list[str] | None = None, suffix: list[str] | None = None) -> Column:
    """Whether a namespace array starts and ends with the given parts."""
    lit = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    out = F.lit(True)
    if prefix:
        out = out & (F.slice(ns, 1, len(prefix)) == lit(prefix))
    if suffix:
        out = out & (F.size(ns) >= len(suffix)) & (F.slice(ns, F.greatest(F.size(ns) - len(suffix) + 1, F.lit(1)), len(suffix)) == lit(suffix))
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str], now: str = "now") -> DataFrame:
    """keys, value, created_at, updated_at: new rows win, but keep the old row's created_at. One full join; both sides unique by key."""
    o = old.select(*keys, F.col("value").alias("ov"), F.col("created_at").alias("oc"), F.col("updated_at").alias("ou"))
    n = new.select(*keys, F.col("value").alias("nv"), F.col(now).alias("n_at"))
    isnew = F.col("n_at").isNotNull()
    return o.join(n, keys, "full").select(*keys, F.when(isnew, F.col("nv")).otherwise(F.col("ov")).alias("value"), F.coalesce("oc", "n_at").alias("created_at"), F.when(isnew, F.col("n_at")).otherwise(F.col("ou")).alias("updated_at"))


def replace_prefix(old: DataFrame, new: DataFrame, prefix: list[str]) -> DataFrame:
    """Everything under a namespace prefix gives way to the new rows; new rows outside it are an error in the plan, not dropped."""
    inside = namespace_matches(F.col("namespace"), prefix=prefix)
    checked = new.withColumn("key", F.when(inside, F.col("key")).otherwise(F.raise_error(F.lit("row outside the prefix"))))
    return old.where(~inside).unionByName(checked)


def update_index(chunks: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """An index after a diff: chunks of removed and modified documents go, fresh chunks of added and modified ones come. changes: doc_id, status."""
    gone = changes.where("status in ('removed', 'modified')").select("doc_id").distinct()
    come = changes.where("status in ('added', 'modified')").select("doc_id").distinct()
    return chunks.join(gone, "doc_id", "left_anti").unionByName(fresh.join(come, "doc_id", "left_semi"))


def stale(records: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Records of which any stated fingerprint or version differs (null differs); nothing stated, nothing stale."""
    if not wanted:
        return records.where(F.lit(False))
    out = F.lit(False)
    for c, v in wanted.items():
        out = out | ~F.col(c).eqNullSafe(F.lit(v))
    return records.where(out)
