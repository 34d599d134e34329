"""Queries of the general data problems: span hierarchies and nested records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, nested
from ..session import shared_dir, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.circular_spans(spark, hierarchy.span_edges(table(spark, d, "runlog")))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.run_hierarchy(spark, table(spark, d, "runlog"))
    return tree.withColumn("path", F.concat(F.lit("/"), F.array_join("path", "/")))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.run_hierarchy(spark, table(spark, d, "runlog")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.array_elements(nested.json_texts(table(spark, d, "sarif_reports"), table(spark, d, "runlog")))


def p7_tables(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten(nested.json_texts(table(spark, d, "sarif_reports"), table(spark, d, "runlog")))


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    """The table, key and parent of every row of the tables, without the payload."""
    return p7_tables(spark, d).drop("payload")


def p7_schemas(spark: SparkSession, d: str) -> DataFrame:
    """The typed columns of every tag's table, over the tables as written."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    nested.write_tables(p7_tables(spark, d), path)
    return nested.schemas(spark.read.parquet(path))


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p7_found, p7_tables, p7_links, p7_schemas)}

_SPANS = """
WITH RECURSIVE e AS (SELECT DISTINCT run_id, span_id, parent_span_id AS parent FROM runlog
  WHERE record IN ('span.start', 'span.end') AND run_id IS NOT NULL AND coalesce(span_id, '') <> '' AND parent_span_id <> ''),
"""
ORACLE = {
    "p2_found": _SPANS
    + """
up AS (SELECT run_id, span_id, parent AS above FROM e UNION SELECT up.run_id, up.span_id, e.parent FROM up JOIN e ON e.run_id = up.run_id AND e.span_id = up.above)
SELECT DISTINCT run_id, span_id FROM up WHERE span_id = above""",
    "p2_descendants": """
WITH RECURSIVE n AS (SELECT run_id, span_id, min(CASE WHEN parent_span_id <> '' THEN parent_span_id END) AS parent FROM runlog
  WHERE record IN ('span.start', 'span.end') AND run_id IS NOT NULL AND coalesce(span_id, '') <> '' GROUP BY run_id, span_id),
top AS (SELECT n.run_id, n.span_id FROM n LEFT JOIN n p ON p.run_id = n.run_id AND p.span_id = n.parent WHERE p.span_id IS NULL),
t AS (SELECT run_id, span_id, [span_id] AS ids FROM top
  UNION ALL SELECT n.run_id, n.span_id, list_append(t.ids, n.span_id) FROM t JOIN n ON n.run_id = t.run_id AND n.parent = t.span_id),
x AS (SELECT run_id, span_id AS descendant, len(ids) AS own, unnest(ids) AS span_id, unnest(range(1, len(ids) + 1)) AS place FROM t)
SELECT run_id, span_id, descendant, own - place AS hops FROM x WHERE place < own""",
    "p2_hierarchy": """
WITH RECURSIVE n AS MATERIALIZED (SELECT run_id, span_id, min(CASE WHEN parent_span_id <> '' THEN parent_span_id END) AS parent FROM runlog
  WHERE record IN ('span.start', 'span.end') AND run_id IS NOT NULL AND coalesce(span_id, '') <> '' GROUP BY run_id, span_id),
l AS MATERIALIZED (SELECT n.run_id, n.span_id, p.span_id AS parent FROM n LEFT JOIN n p ON p.run_id = n.run_id AND p.span_id = n.parent),
t AS (SELECT run_id, span_id, [span_id] AS ids FROM l WHERE parent IS NULL
  UNION ALL SELECT l.run_id, l.span_id, list_append(t.ids, l.span_id) FROM t JOIN l ON l.run_id = t.run_id AND l.parent = t.span_id),
s AS (SELECT run_id, span_id, count(*) AS subtree FROM (SELECT run_id, unnest(ids) AS span_id FROM t) GROUP BY run_id, span_id)
SELECT l.run_id, l.span_id, l.parent, '/' || array_to_string(ids, '/') AS path, len(ids) - 1 AS depth, ids[1] AS root, subtree, ids IS NULL AS unrooted
FROM l LEFT JOIN t USING (run_id, span_id) LEFT JOIN s USING (run_id, span_id)""",
    "p7_found": """
WITH x AS (SELECT 'sarif' AS origin, report_id::VARCHAR AS k, ltrim(payload, chr(65279)) AS j FROM sarif_reports UNION ALL SELECT 'runlog', record_id, ltrim(attributes, chr(65279)) FROM runlog),
v AS (SELECT origin, k, j::JSON AS j FROM x WHERE json_valid(j)),
d AS (SELECT origin, k, CASE WHEN json_type(j) = 'VARCHAR' THEN ltrim(j ->> '$', chr(65279)) ELSE j::VARCHAR END AS j FROM v),
w AS (SELECT DISTINCT origin, k, j FROM d WHERE json_valid(j) AND json_type(j) IN ('OBJECT', 'ARRAY'))
SELECT DISTINCT origin, k AS record_key, CASE WHEN fullkey[2:2] = '.' THEN fullkey[3:] ELSE fullkey[2:] END AS child_path
FROM w, json_tree(w.j::JSON) AS t WHERE t.type = 'OBJECT' AND ends_with(fullkey, ']')""",
    "p7_links": """
WITH x AS (SELECT 'sarif' AS origin, report_id::VARCHAR AS k, ltrim(payload, chr(65279)) AS j FROM sarif_reports WHERE payload IS NOT NULL UNION SELECT 'runlog', record_id, ltrim(attributes, chr(65279)) FROM runlog WHERE attributes IS NOT NULL),
d AS (SELECT origin, k, CASE WHEN json_valid(j) THEN CASE WHEN json_type(CASE WHEN json_valid(j) THEN j ELSE 'null' END) = 'VARCHAR' THEN ltrim(CASE WHEN json_valid(j) THEN j ELSE 'null' END ->> '$', chr(65279)) ELSE j END ELSE j END AS j FROM x),
w AS (SELECT DISTINCT origin, k, j FROM d WHERE json_valid(j)),
o AS (SELECT origin, k, CASE WHEN fullkey[2:2] = '.' THEN fullkey[3:] ELSE fullkey[2:] END AS path FROM w, json_tree(w.j::JSON) AS t WHERE t.type = 'OBJECT')
SELECT DISTINCT origin, k AS record_key, regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS tag, path, CASE WHEN regexp_matches(path, '^(\\[\\d+\\])*$') THEN NULL ELSE regexp_replace(path, '(^|\\.)[^.\\[\\]]+(\\[\\d+\\])*$', '') END AS parent_path, ends_with(path, ']') AS in_array FROM o
UNION ALL SELECT DISTINCT origin, k, '#broken', '', NULL, false FROM d WHERE NOT json_valid(j)""",
}
