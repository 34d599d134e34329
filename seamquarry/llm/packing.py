"""Filling containers of fixed capacity: bounded-space online best-fit.

Each partition packs the documents it reads, in one pass and without a shuffle, holding a fixed number of open containers in
a bitset keyed by their free space. An item goes where it leaves the least room; if it fits nowhere, the fullest container is
closed for a new one. What is still open at a partition's end stays as it is, so the room unused beyond best-fit's own is at
most OPEN containers for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import VOCABULARY, counter

OPEN = 64
PACKED = "container string, bin_id string, doc_id bigint, part int, token_start bigint, tokens int"


class Bins:
    """The open containers of one capacity."""

    def __init__(self, capacity: int, limit: int = OPEN):
        self.capacity, self.limit, self.bits, self.made, self.count = capacity, limit, 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def put(self, size: int) -> int:
        """The number of the container that takes an item of 1 to capacity tokens."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.count == self.limit and size < self.capacity:  # a full container needs no place among the open ones
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, free = self.made, self.capacity
            self.made += 1
        if free - size:
            self.by_free.setdefault(free - size, []).append(bin_)
            self.bits |= 1 << (free - size)
            self.count += 1
        return bin_

    def _take(self, free: int) -> int:
        same = self.by_free[free]
        bin_ = same.pop()
        self.count -= 1
        if not same:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        return bin_


def _pack(capacities: list[tuple[str, int]], vocabulary: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary)
        task = TaskContext.get()
        where = task.partitionId() if task else 0
        bins = [(name, cap, Bins(cap)) for name, cap in capacities]
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"]):
                n = count(text)
                for name, cap, open_ in bins:
                    for part, at in enumerate(range(0, n, cap)):
                        size = min(cap, n - at)
                        out.append((name, f"{name}-{where}-{open_.put(size)}", doc, part, at, size))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PACKED.split(", ")])

    return run


def pack(documents: DataFrame, sizes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """PACKED: where each document goes, for each kind of container. Only documents larger than a container are split, into full runs and a rest.

    Null and empty texts have no tokens and go nowhere; every other row is packed, copies too. `sizes` is a fixed table of
    container and capacity_tokens; null or non-positive capacities are left out.
    """
    caps = [(r.container, r.capacity_tokens) for r in sizes.where("capacity_tokens > 0 and container is not null").orderBy("container").collect()]
    return documents.where(F.length("text") > 0).select("doc_id", "text").mapInPandas(_pack(caps, vocabulary), PACKED)


def fill(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """container, capacity_tokens, bins, tokens, filled: how full the containers are."""
    per = packed.groupBy("container").agg(F.countDistinct("bin_id").alias("bins"), F.sum("tokens").alias("tokens"))
    return per.join(sizes.select("container", "capacity_tokens"), "container").withColumn("filled", F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")))
