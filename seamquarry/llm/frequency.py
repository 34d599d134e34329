"""How often every distinct term occurs, in how many records, and which terms are too rare or too common."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch

SEPARATORS = "[,;/|]"
RARE_BELOW = 3
COMMON_ABOVE = 0.1


def _terms(cell: str):
    """The pieces of a cell, in order, stripped and upper-cased, empty ones dropped."""
    strip = lambda x: F.upper(F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    return F.filter(F.transform(F.split(F.coalesce(F.col(cell), F.lit("")), SEPARATORS), strip), lambda x: x != "")


def term_counts(spark: SparkSession, records: DataFrame, key: str, fields: list[str], rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """field, term, occurrences, records, mark (rare, common or null) over all distinct records of `key`.

    Each record emits its own term counts; these are summed by hash within a partition before the shuffle, so a term that
    a third of all rows hold travels once for each partition. Repeated rows of a key count once (they are the same
    record). Null and empty cells hold no term, but their records count in the total. No rows: no terms.
    """
    once = Scratch(spark).write(records.groupBy(key).agg(*(F.first(f).alias(f) for f in fields)))
    total = once.count()
    cells = F.array(*(F.struct(F.lit(f).alias("field"), _terms(f).alias("terms")) for f in fields))
    per_record = (
        once.select(F.explode(cells).alias("c"))
        .select("c.field", F.col("c.terms").alias("terms"))
        .where(F.size("terms") > 0)
        .select("field", F.explode(F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("n")))).alias("t"))
        .select("field", "t.term", "t.n")
    )
    counted = per_record.groupBy("field", "term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * total, "common")
    return counted.withColumn("mark", mark)
