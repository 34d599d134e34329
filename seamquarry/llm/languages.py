"""The language of a path, by its ending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_ending(languages: DataFrame) -> DataFrame:
    """ending, language, max_chars, overlap_chars: one row for each ending; of two languages the first by name."""
    e = languages.select(F.explode("extensions").alias("ending"), "language", "max_chars", "overlap_chars").where("ending is not null")
    return e.groupBy(F.lower("ending").alias("ending")).agg(*(F.min_by(c, "language").alias(c) for c in ("language", "max_chars", "overlap_chars")))


def with_language(df: DataFrame, path: str, languages: DataFrame) -> DataFrame:
    """df with the columns of `by_ending`, null where no language has the path's ending (any letter case).

    `languages` is a fixed table of a few rows; Spark broadcasts it by its size and joins by hash where it isn't small.
    """
    ending = F.lower(F.regexp_extract(F.col(path), r"\.[^.\\/]*$", 0))
    return df.withColumn("ending", ending).join(by_ending(languages), "ending", "left")
