"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import encoding, frequency, handwritten, mixing, neardup, packing, splitting, syntax
from .languages import with_language

TEXTS = ["issue", "reasoning", "mitigation"]


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return with_language(table(spark, d, "review_requests"), "file_path", table(spark, d, "languages"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    cols = ["item_kind", "item_id", "text", "max_chars", "overlap_chars", "markdown"]
    requests = _requests(spark, d).select(F.lit("request").alias("item_kind"), F.col("request_id").alias("item_id"), F.col("snippet").alias("text"), "max_chars", "overlap_chars", (F.col("language") == "markdown").alias("markdown"))
    sources = table(spark, d, "threat_sources").withColumn("language", F.lit("markdown")).join(table(spark, d, "languages").select("language", "max_chars", "overlap_chars"), "language")
    sources = sources.select(F.lit("threat_source").alias("item_kind"), F.col("source_id").alias("item_id"), F.col("source").alias("text"), "max_chars", "overlap_chars", F.lit(True).alias("markdown"))
    return requests.select(*cols).unionByName(sources.select(*cols))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.checked(_requests(spark, d)).where("not valid").select("request_id")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(syntax.checked(_requests(spark, d)))


def p1_graph_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How the last code-graph build's failed files and syntax diagnostics agree with the parser, per repository and kind."""
    done = syntax.checked(_requests(spark, d).withColumn("repo", F.col("repo")))
    paths = table(spark, d, "review_requests").select("request_id", "repo", F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), r"^(?:\./)+", "").alias("identity")).distinct()
    log = table(spark, d, "codegraph_records").where(F.col("kind").isin("failed", "diagnostic", "processed"))
    last = log.groupBy("repo").agg(F.max("graph_revision").alias("graph_revision"))
    said = log.join(last, ["repo", "graph_revision"], "left_semi").select("repo", F.split("identity", "::")[0].alias("identity"), "kind").distinct()
    met = done.select("request_id", "valid").join(paths, "request_id").join(said, ["repo", "identity"])
    return met.groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("broken"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = neardup.near_pairs(spark, table(spark, d, "review_findings"), "finding_id", TEXTS)
    return neardup.record_pairs(members, pairs).select(F.col("a").alias("finding_id_a"), F.col("b").alias("finding_id_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each finding with its class of equal word sets, the number of classes that are near it, and the group that near classes join up to."""
    members, pairs = neardup.near_pairs(spark, table(spark, d, "review_findings"), "finding_id", TEXTS)
    return neardup.groups(spark, members, pairs).withColumnRenamed("id", "finding_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.foreign_files(table(spark, d, "review_requests"), table(spark, d, "vendored_index"))


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.scores(table(spark, d, "review_requests"), table(spark, d, "vendored_index"))


def p4_validation(spark: SparkSession, d: str) -> DataFrame:
    """How the classifiers agree with the weak labels on the fitting rows, by repository; held-out repositories were not trained on."""
    return handwritten.validation(table(spark, d, "review_requests"), table(spark, d, "vendored_index"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.piece_spans(_items(spark, d)).where("piece_no = 1").select("item_kind", "item_id")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(_items(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_counts(spark, d).where("mark is not null").select("field", "term", "mark")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_counts(spark, table(spark, d, "review_findings"), "finding_id", ["cwe", "severity"])


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_packed(spark, d), table(spark, d, "pack_sizes"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spark, table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p9_mix_stretched(spark: SparkSession, d: str) -> DataFrame:
    """As p9_mix, with a total half-way from the most the scarcest source allows to all that the sources can give."""
    return mixing.mix(spark, table(spark, d, "documents"), table(spark, d, "mix_targets"), stretch=0.5)


def p9_shares_stretched(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix_stretched(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.damaged_documents(spark, table(spark, d, "documents"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored(spark, table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [p1_found, p1_rates, p1_graph_agreement, p3_found, p3_classes, p4_found, p4_scores, p4_validation, p5_found, p5_pieces, p6_found, p6_counts, p8_packed, p8_fill, p9_mix, p9_shares, p9_mix_stretched, p9_shares_stretched, p10_found, p10_restored]
    return {f.__name__: f for f in every}


_TERMS = """
WITH f AS (SELECT finding_id, any_value(cwe) AS cwe, any_value(severity) AS severity FROM review_findings GROUP BY finding_id),
cells AS (SELECT finding_id, 'cwe' AS field, cwe AS cell FROM f UNION ALL SELECT finding_id, 'severity', severity FROM f),
pieces AS (SELECT finding_id, field, upper(trim(unnest(regexp_split_to_array(cell, '[,;/|]')), E' \\t\\r\\n')) AS term FROM cells WHERE cell IS NOT NULL),
counted AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT finding_id) AS records FROM pieces WHERE term <> '' GROUP BY field, term),
marked AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.1 * (SELECT count(*) FROM f) THEN 'common' END AS mark FROM counted)
"""
_ITEMS = """
WITH e AS (SELECT lower(unnest(extensions)) AS ending, max_chars FROM languages),
i AS (
  SELECT 'request' AS item_kind, request_id AS item_id, snippet AS text, max_chars
  FROM review_requests JOIN e ON lower(regexp_extract(file_path, '\\.[^.\\\\/]*$')) = ending
  UNION ALL
  SELECT 'threat_source', source_id, source, (SELECT max_chars FROM languages WHERE language = 'markdown') FROM threat_sources)
"""


_WORDS = """
WITH f AS (SELECT finding_id, lower(concat_ws(' ', coalesce(any_value(issue), ''), coalesce(any_value(reasoning), ''), coalesce(any_value(mitigation), ''))) AS t FROM review_findings GROUP BY finding_id),
w AS MATERIALIZED (SELECT finding_id, unnest(list_distinct(regexp_extract_all(t, '[a-z0-9_]+'))) AS w FROM f),
n AS (SELECT finding_id, count(*) AS n FROM w GROUP BY finding_id),
p AS (SELECT a.finding_id AS a, b.finding_id AS b, count(*) AS k FROM w a JOIN w b ON a.w = b.w AND a.finding_id < b.finding_id GROUP BY ALL)
SELECT a AS finding_id_a, b AS finding_id_b FROM p JOIN n x ON x.finding_id = a JOIN n y ON y.finding_id = b WHERE k >= 0.75 * (x.n + y.n - k)"""


_CLASSES = """
WITH RECURSIVE f AS (SELECT finding_id, lower(concat_ws(' ', coalesce(any_value(issue), ''), coalesce(any_value(reasoning), ''), coalesce(any_value(mitigation), ''))) AS t FROM review_findings GROUP BY finding_id),
k AS MATERIALIZED (SELECT finding_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[a-z0-9_]+'))), ' ') AS ws FROM f),
c AS MATERIALIZED (SELECT finding_id, min(finding_id) OVER (PARTITION BY ws) AS class_id, ws FROM k),
w AS MATERIALIZED (SELECT class_id, unnest(string_split(ws, ' ')) AS w FROM c WHERE finding_id = class_id AND ws <> ''),
n AS (SELECT class_id, count(*) AS n FROM w GROUP BY class_id),
p AS MATERIALIZED (SELECT a, b FROM (SELECT a.class_id AS a, b.class_id AS b, count(*) AS k FROM w a JOIN w b ON a.w = b.w AND a.class_id <> b.class_id GROUP BY ALL) JOIN n x ON x.class_id = a JOIN n y ON y.class_id = b WHERE k >= 0.75 * (x.n + y.n - k)),
g AS (SELECT a AS class_id, a AS m FROM p UNION SELECT g.class_id, p.b FROM g JOIN p ON p.a = g.m)
SELECT finding_id, class_id, coalesce(links, 0) AS links, coalesce(group_id, class_id) AS group_id FROM c
LEFT JOIN (SELECT a AS class_id, count(*) AS links FROM p GROUP BY a) USING (class_id) LEFT JOIN (SELECT class_id, min(m) AS group_id FROM g GROUP BY class_id) USING (class_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _WORDS,
        "p3_classes": _CLASSES,
        "p6_found": _TERMS + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
        "p6_counts": _TERMS + "SELECT field, term, occurrences, records, mark FROM marked",
        "p5_found": _ITEMS + "SELECT DISTINCT item_kind, item_id FROM i WHERE length(text) > max_chars",
    }
