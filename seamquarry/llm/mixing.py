"""Mixing sources to target weights by hierarchical budgeting.

Weights go down a tree of domains, their sources and these sources' languages: a source weighs its target, a domain its
sources' targets, a language its size. A node that cannot use up its budget (its size times its permitted repeats) hands the
rest to its siblings by their weights, and only what they cannot take either goes up to their parent's siblings. (The targets
are of sources, so the language is below the source and not above it: above, a shortage would pass from source to source.)
Each leaf then takes whole epochs and, of the next one, a token prefix in a seeded order. The prefix is found from sums over
hash buckets, so no task ever holds a leaf in order. Where it ends, whole documents rarely fit: what the leaves of a source
leave over together is filled with its next documents that still fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .tokens import VOCABULARY, counter

#: Documents to a bucket, about; the number of buckets follows the number of documents.
IN_BUCKET = 2_000
# The domain of each source: texts of the repository itself, and what people and tools say about it. A source that is not named is its own.
DOMAINS = {"repo_source": "repository", "commit_notes": "repository", "design_notes": "repository", "review_reports": "review", "triage_notes": "review", "ask_sessions": "review", "threat_models": "security", "advisories": "security"}


def _sizes(vocabulary: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "lang": b["lang"], "tokens": [count(t) for t in b["text"]]})

    return run


def share_out(amount: float, weights: list[float], room: list[float]) -> list[float]:
    """The amount by weight, no more than the room each has; what one cannot take goes to the others by their weights."""
    got = [0.0] * len(weights)
    while amount > 1e-9:
        free = [i for i in range(len(weights)) if weights[i] > 0 and room[i] - got[i] > 1e-9]
        if not free:
            break
        total = sum(weights[i] for i in free)
        part = {i: min(amount * weights[i] / total, room[i] - got[i]) for i in free}
        for i, x in part.items():
            got[i] += x
        amount -= sum(part.values())
    return got


def spread(amount: float, tree: dict) -> dict:
    """The amount over a tree, by its leaves. A node is {name: (weight, room, subtree or None)}; room is what its leaves can take together."""
    out = {}
    names = sorted(tree, key=lambda x: (x is not None, x or ""))
    for name, x in zip(names, share_out(amount, [tree[k][0] for k in names], [tree[k][1] for k in names])):
        below = tree[name][2]
        out.update({(name,): x} if below is None else {(name, *k): v for k, v in spread(x, below).items()})
    return out


def budgets(leaves: list[tuple[str, str | None, int]], targets: dict[str, tuple[float, int]], total: float | None = None, stretch: float = 0.0, domains: dict[str, str] = DOMAINS) -> dict[tuple[str, str | None], float]:
    """Tokens to take of each (source, language). Without a total: the most at which every source reaches its share exactly,
    and of what the sources could give beyond that the part `stretch` (0 to 1), where the scarce ones hand on their budgets.
    """
    by: dict[str, list[tuple[str | None, int]]] = {}
    for s, lang, n in leaves:
        if s in targets and n > 0 and targets[s][0] > 0 and targets[s][1] > 0:
            by.setdefault(s, []).append((lang, n))
    tree: dict = {}
    for s, langs in by.items():
        weight, repeats = targets[s]
        tree.setdefault(domains.get(s, s), {})[s] = (weight, repeats * sum(n for _, n in langs), {lang: (n, n * repeats, None) for lang, n in langs})
    top = {d: (sum(x[0] for x in t.values()), sum(x[1] for x in t.values()), t) for d, t in tree.items()}
    if total is None:
        sources = [x for t in tree.values() for x in t.values()]
        total = min((room * sum(w for w, _, _ in sources) / w for w, room, _ in sources), default=0.0)
        total += stretch * (sum(room for _, room, _ in sources) - total)
    return {k[1:]: v for k, v in spread(total, top).items()}


def _top_up(b: pd.DataFrame) -> pd.DataFrame:
    """Of one source's documents at the ends of its prefixes, in order, those that still fit; then the one, if any, that comes nearest."""
    b = b.sort_values(["behind", "rank", "doc_id"])
    left, tokens = float(b["left"].iloc[0]), b["tokens"].to_numpy()
    more = np.zeros(len(b), np.int32)
    for i, n in enumerate(tokens):
        if n <= left:
            more[i], left = 1, left - n
    rest = np.flatnonzero(more == 0)
    if len(rest) and (n := tokens[rest].min()) < 2 * left:
        more[rest[tokens[rest] == n][0]] = 1
    return b.assign(copies=b["epochs"] + more)[["doc_id", "source", "lang", "tokens", "copies"]]


def mix(spark: SparkSession, documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, vocabulary: str = VOCABULARY, stretch: float = 0.0) -> DataFrame:
    """doc_id, source, lang, tokens, copies: how often each drawn document is used.

    A document of a source without a target, or with a null source, or without tokens, is not drawn. A source without documents is left
    out and the others keep their weights to each other. Null languages are a language of their own.
    """
    rows = documents.where(F.col("source").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    tmp = Scratch(spark)
    sized = tmp.write(rows.select("doc_id", "source", "lang", "text").mapInPandas(_sizes(vocabulary), "doc_id bigint, source string, lang string, tokens bigint"))
    want = {r.source: (r.target_share, r.max_repeats) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").collect()}
    found = sized.where(F.col("source").isin(*want)).groupBy("source", "lang").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()
    leaves = [(r.source, r.lang, r.tokens) for r in found]
    size = {(s, lang): n for s, lang, n in leaves}
    buckets = max(16, math.ceil(sum(r.n for r in found) / IN_BUCKET))
    plan = [(s, lang, int(b // size[s, lang]), float(b - b // size[s, lang] * size[s, lang])) for (s, lang), b in budgets(leaves, want, total, stretch).items()]
    plan_df = spark.createDataFrame(plan, "source string, lang string, epochs int, rest double")
    on = lambda x, y: (F.col(f"{x}.source") == F.col(f"{y}.source")) & F.col(f"{x}.lang").eqNullSafe(F.col(f"{y}.lang"))
    drawn = sized.alias("d").join(plan_df.alias("p"), on("d", "p")).select("d.*", "epochs", "rest")
    drawn = drawn.withColumn("rank", F.xxhash64(F.lit(seed), F.col("epochs"), "doc_id")).withColumn("bucket", F.pmod(F.shiftrightunsigned("rank", 20), F.lit(buckets)).cast("int"))
    leaf = Window.partitionBy("source", "lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = drawn.groupBy("source", "lang", "bucket", "rest").agg(F.sum("tokens").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(leaf), F.lit(0)))
    edge = tmp.write(sums.where("before < rest").groupBy("source", "lang").agg(F.max("bucket").alias("edge"), F.min(F.col("rest") - F.col("before")).alias("left")))
    left = edge.groupBy("source").agg(F.sum("left").alias("left"))
    met = drawn.alias("d").join(edge.select("source", "lang", "edge").alias("e"), on("d", "e"), "left").select("d.*", (F.col("bucket") - F.col("edge")).alias("behind"))
    cols = ["doc_id", "source", "lang", "tokens"]
    at_end = met.where("behind in (0, 1)").join(left, "source").select(*cols, "epochs", "behind", "rank", "left")
    filled = at_end.groupBy("source").applyInPandas(_top_up, "doc_id bigint, source string, lang string, tokens bigint, copies int")
    plain = met.where("behind is null or behind not in (0, 1)").select(*cols, (F.col("epochs") + F.coalesce((F.col("behind") < 0).cast("int"), F.lit(0))).alias("copies"))
    return filled.unionByName(plain).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, deviation, tokens, documents, most_copies for each target."""
    per = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    full = targets.select("source", "target_share").join(per, "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
    everything = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row for each target
    actual = F.when(everything > 0, F.col("tokens") / everything).otherwise(F.lit(0.0))
    return full.withColumn("actual_share", actual).withColumn("deviation", F.col("actual_share") - F.col("target_share"))
