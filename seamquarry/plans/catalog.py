"""Queries for the operators on source, findings, graphs and stores, over whole tables, with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import c_facts, evidence, graph, hierarchy, reports, retrieval, snippets, source_text
from ..session import table
from ..streaming import trace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
S = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


REQ = "(SELECT request_id, any_value(repo) AS repo, any_value(file_path) AS file_path, any_value(mode) AS mode, any_value(snippet) AS snippet, any_value(relative_file) AS relative_file FROM review_requests GROUP BY request_id)"
FIND = "(SELECT DISTINCT ON (finding_id) * FROM review_findings ORDER BY finding_id, received_at)"
NORM = f"""(SELECT finding_id, repo, file, line, start_line, end_line, run_id, regexp_replace(coalesce(issue, ''), '^{S}+|{S}+$', '', 'g') AS issue,
  regexp_replace(coalesce(reasoning, ''), '^{S}+|{S}+$', '', 'g') AS reasoning, regexp_replace(coalesce(mitigation, ''), '^{S}+|{S}+$', '', 'g') AS mitigation,
  CASE WHEN c = '' THEN 'CWE-Unknown' ELSE c END AS cwe,
  CASE upper(s) WHEN '' THEN 'Unknown' WHEN 'CRITICAL' THEN 'Critical' WHEN 'HIGH' THEN 'High' WHEN 'MEDIUM' THEN 'Medium' WHEN 'LOW' THEN 'Low' ELSE s END AS severity,
  CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0.0 ELSE confidence END AS confidence
  FROM (SELECT *, regexp_replace(coalesce(cwe, ''), '^{S}+|{S}+$', '', 'g') AS c, regexp_replace(coalesce(severity, ''), '^{S}+|{S}+$', '', 'g') AS s FROM {FIND}))"""
LINES = f"""(SELECT request_id, line, line_text FROM (
  SELECT request_id, unnest(ls) AS line_text, unnest(range(1, len(ls) + 1)) AS line FROM (
    SELECT request_id, CASE WHEN t = '' THEN [] WHEN ends_with(t, chr(10)) THEN ls[1:greatest(len(ls) - 1, 1)] ELSE ls END AS ls
    FROM (SELECT request_id, t, string_split(t, chr(10)) AS ls FROM (SELECT request_id, regexp_replace(coalesce(snippet, ''), '\\r\\n?', chr(10), 'g') AS t FROM {REQ})))))"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    return source_text.once(table(spark, d, "review_requests"), "request_id")


def findings(spark: SparkSession, d: str) -> DataFrame:
    return reports.normalised(source_text.once(table(spark, d, "review_findings"), "finding_id"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return source_text.line_index(requests(spark, d), "request_id", "snippet")


# Text


@query(
    f"""WITH w AS (SELECT request_id, unnest(l) AS whole, unnest(range(1, len(l) + 1)) AS line FROM (SELECT request_id, regexp_extract_all(coalesce(snippet, ''), '[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+') AS l FROM {REQ}))
    SELECT request_id, line, (sum(octet_length(encode(whole))) OVER (PARTITION BY request_id ORDER BY line) - octet_length(encode(whole)))::BIGINT AS start_byte, octet_length(encode(rtrim(whole, chr(13) || chr(10)))) AS n_bytes FROM w"""
)
def line_index(spark, d):
    return lines(spark, d).select("request_id", "line", "start_byte", "n_bytes")


@query(f"SELECT doc_id, left(sha256(regexp_replace(regexp_replace(text, '{S}+', ' ', 'g'), '^ | $', '', 'g')), 16) AS content_hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


_COPIES = f"(SELECT doc_id, source, content_hash, min(doc_id) OVER (PARTITION BY content_hash) AS kept, count(*) OVER (PARTITION BY content_hash) AS group_size FROM (SELECT doc_id, source, left(sha256(regexp_replace(regexp_replace(text, '{S}+', ' ', 'g'), '^ | $', '', 'g')), 16) AS content_hash FROM documents WHERE text IS NOT NULL))"


@query(f"SELECT doc_id, content_hash, kept, group_size FROM {_COPIES}")
def exact_dedup(spark, d):
    return source_text.copies(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "content_hash", "kept", "group_size")


@query(f"SELECT source, count(*) AS docs, count_if(doc_id = kept) AS kept, count_if(doc_id <> kept) AS removed FROM {_COPIES} GROUP BY source")
def duplicate_report(spark, d):
    docs = table(spark, d, "documents")
    c = source_text.copies(docs, "doc_id", "text").join(docs.select("doc_id", "source"), "doc_id")
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("doc_id") == F.col("kept")).alias("kept"), F.count_if(F.col("doc_id") != F.col("kept")).alias("removed"))


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0))::BIGINT END AS tokens, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 3.2::DOUBLE))::BIGINT END AS tokens_small FROM documents")
def token_estimate(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.token_estimate(t, 4.0).alias("tokens"), T.token_estimate(t, T.family_ratio(F.lit("codellama-7b"))).alias("tokens_small"))


@query(
    "WITH w AS (SELECT finding_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS p FROM (SELECT finding_id, regexp_extract_all(coalesce(reasoning, ''), '[A-Za-z_][A-Za-z0-9_]{3,}') AS l FROM " + FIND + ")), "
    "k AS (SELECT finding_id, w, min(p) AS p FROM w WHERE lower(w) NOT IN (" + ", ".join(f"'{x}'" for x in T.STOP_TERMS) + ") GROUP BY finding_id, w), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY p) AS n FROM k) "
    "SELECT f.finding_id, coalesce(string_agg(w, ' ' ORDER BY p), '') AS terms FROM " + FIND + " f LEFT JOIN r ON r.finding_id = f.finding_id AND n <= 6 GROUP BY f.finding_id"
)
def prose_terms(spark, d):
    f = source_text.once(table(spark, d, "review_findings"), "finding_id")
    return f.select("finding_id", F.array_join(T.terms(F.col("reasoning")), " ").alias("terms"))


@query(
    r"WITH w AS (SELECT request_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS p FROM (SELECT request_id, regexp_extract_all(coalesce(snippet, ''), '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1) AS l FROM " + REQ + ")), "
    "k AS (SELECT request_id, w, min(p) AS p FROM w GROUP BY request_id, w), r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY p) AS n FROM k) "
    "SELECT q.request_id, coalesce(string_agg(w, ' ' ORDER BY p), '') AS names FROM " + REQ + " q LEFT JOIN r ON r.request_id = q.request_id AND n <= 10 GROUP BY q.request_id"
)
def call_names(spark, d):
    return requests(spark, d).select("request_id", F.array_join(T.call_names(F.col("snippet")), " ").alias("names"))


@query(f"SELECT finding_id, CASE WHEN v = '' THEN 'other' ELSE v END AS sink_type FROM (SELECT finding_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(cwe, 'other'))), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS v FROM {FIND})")
def sink_names(spark, d):
    return source_text.once(table(spark, d, "review_findings"), "finding_id").select("finding_id", T.sink_type(F.col("cwe")).alias("sink_type"))


@query(f"SELECT finding_id, sha256(concat_ws(':', coalesce(file, ''), coalesce(line::VARCHAR, ''), coalesce(cwe, ''))) AS fingerprint FROM {FIND}")
def location_fingerprint(spark, d):
    f = source_text.once(table(spark, d, "review_findings"), "finding_id")
    return f.select("finding_id", T.location_fingerprint(F.col("file"), F.col("line"), F.col("cwe")).alias("fingerprint"))


@query(f"SELECT request_id, sha256(snippet) AS file_hash FROM {REQ} WHERE snippet IS NOT NULL")
def file_fingerprint(spark, d):
    return requests(spark, d).where("snippet is not null").select("request_id", F.sha2("snippet", 256).alias("file_hash"))


_MULTISET = lambda h: "sha256(concat_ws(' ', " + ", ".join(f"sum(('0x' || substr({h}, {1 + 15 * i}, 15))::UBIGINT::HUGEINT)::VARCHAR" for i in range(4)) + "))"


@query(f"SELECT repo, {_MULTISET('h')} AS fingerprint FROM (SELECT repo, sha256(file_path || ' ' || sha256(snippet)) AS h FROM {REQ} WHERE snippet IS NOT NULL) GROUP BY repo")
def repo_fingerprint(spark, d):
    """A hash of each repository's files, in no order, from sums that are partial before the shuffle."""
    h = requests(spark, d).where("snippet is not null").select("repo", F.sha2(F.concat("file_path", F.lit(" "), F.sha2("snippet", 256)), 256).alias("h"))
    return h.groupBy("repo").agg(T.multiset_hash(F.col("h")).alias("fingerprint"))


@query(f"SELECT request_id, line, line_text FROM {LINES} WHERE regexp_matches(line_text, 'memcpy\\s*\\(')")
def grep_calls(spark, d):
    return source_text.grep(lines(spark, d), r"memcpy\s*\(", "request_id")


@query(
    f"""WITH n AS (SELECT request_id, count(*) AS n FROM {LINES} GROUP BY request_id),
    f AS (SELECT f.finding_id, q.request_id, greatest(f.line, 1) AS line FROM {FIND} f JOIN {REQ} q ON q.repo = f.repo AND q.file_path = f.file WHERE f.line IS NOT NULL),
    w AS (SELECT finding_id, f.request_id, greatest(1, least(f.line - 2, n)) AS a, greatest(greatest(1, least(f.line - 2, n)), least(f.line + 2, n)) AS b FROM f JOIN n USING (request_id))
    SELECT finding_id, request_id, string_agg(lpad(l.line::VARCHAR, length(b::VARCHAR)::INT, ' ') || ': ' || line_text, chr(10) ORDER BY l.line) AS context
    FROM w JOIN {LINES} l USING (request_id) WHERE l.line BETWEEN a AND b GROUP BY finding_id, request_id"""
)
def context_window(spark, d):
    """The lines around each finding's. A finding meets only the five lines it shows, not its file's text."""
    r = requests(spark, d)
    n = r.select("repo", F.col("file_path").alias("file"), "request_id", F.size(T.lines_of(F.col("snippet"))).alias("n_lines")).where("n_lines > 0")
    f = source_text.once(table(spark, d, "review_findings"), "finding_id").where("line is not null").select("finding_id", "repo", "file", "line").join(n, ["repo", "file"])
    return source_text.windows(f, source_text.line_index(r, "request_id", "snippet"), "finding_id", "request_id", 2).withColumnRenamed("shown", "context")


@query()
def token_chunks(spark, d):
    return source_text.chunks(requests(spark, d), "request_id", "snippet", "halved", 256)


@query()
def line_chunks(spark, d):
    """Windows of lines by the profile of each file's ending."""
    r = requests(spark, d).withColumn("profile", source_text.profile(F.col("file_path")))
    return source_text.chunks(r, "request_id", "snippet", "lines")


@query()
def doc_chunks(spark, d):
    """Documents in chunks of whole sentences."""
    return source_text.chunks(table(spark, d, "documents"), "doc_id", "text", "sentences", 1024)


def _by_path(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Findings and files with one column for repository and path; path stays the file's own for its ending."""
    files = requests(spark, d).select(F.concat_ws("\n", "repo", "file_path").alias("path"), F.col("snippet").alias("source"))
    f = source_text.once(table(spark, d, "review_findings"), "finding_id")
    f = f.select("finding_id", F.concat_ws("\n", "repo", "file").alias("path"), "line", "code_snippet", "start_line", "end_line", F.concat_ws("\n", "issue", "reasoning").alias("context"))
    return f, files


@query()
def snippet_locations(spark, d):
    return snippets.locate_snippets(*_by_path(spark, d))


@query()
def finding_anchors(spark, d):
    """The anchor of each located finding: its display id, and one that doesn't change when lines move."""
    f, files = _by_path(spark, d)
    a = snippets.locate_snippets(f, files).where("first_line is not null").join(f.select("finding_id", "path"), "finding_id")
    file = F.substring_index("path", "\n", -1)
    shown = F.concat(file, F.lit(":"), F.col("first_line"), F.when(F.col("last_line") > F.col("first_line"), F.concat(F.lit("-"), "last_line")).otherwise(F.lit("")))
    stable = snippets.stable_id(file, F.col("symbol"), F.col("content_hash"))
    return a.select("finding_id", "confidence", shown.alias("display_id"), stable.alias("stable_id"), F.sha2(stable, 256).alias("fingerprint"))


@query()
def finding_functions(spark, d):
    """The function at each finding's line in C and C++ files, as many of its lines as the budget holds."""
    f, files = _by_path(spark, d)
    return snippets.functions_at(f.where(F.lower("path").rlike(snippets.C_ENDINGS)), files)


@query()
def chunk_anchors(spark, d):
    r = requests(spark, d).where("snippet <> ''").select("request_id", "snippet", F.col("file_path").alias("path"))
    return snippets.chunk_anchors(r, source_text.chunks(r, "request_id", "snippet", "halved", 256), "request_id", "snippet")


def _patches(spark: SparkSession, d: str) -> DataFrame:
    """A patch that adds each file."""
    r = requests(spark, d).select("request_id", T.repo_path(F.col("file_path")).alias("path"), T.lines_of(F.col("snippet")).alias("ls")).where("size(ls) > 0")
    body = F.array_join(F.transform("ls", lambda x: F.concat(F.lit("+"), x)), "\n")
    head = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n--- /dev/null\n+++ b/"), "path", F.lit("\n@@ -0,0 +1,"), F.size("ls"), F.lit(" @@\n"))
    return r.select("request_id", F.concat(head, body).alias("patch"))


_PATH = f"(SELECT request_id, regexp_replace(regexp_replace(regexp_replace(file_path, '\\\\', '/', 'g'), '^(\\./+)+', ''), '/{{2,}}', '/', 'g') AS path FROM {REQ})"


@query(f"SELECT request_id, path, 'added' AS file_status, 1 AS hunk, line AS line_no, '+' AS op, line_text AS value FROM {LINES} JOIN {_PATH} USING (request_id)")
def patch_lines(spark, d):
    """The lines of patches that add each file, read back from the patches' text."""
    return source_text.diff_lines(_patches(spark, d), "request_id", "patch")


@query(f"SELECT request_id, any_value(path) AS path, sha256(string_agg(line_text, chr(10) ORDER BY line)) AS added_hash FROM {LINES} JOIN {_PATH} USING (request_id) GROUP BY request_id")
def added_text(spark, d):
    return source_text.added_text(source_text.diff_lines(_patches(spark, d), "request_id", "patch"), "request_id").select("request_id", "path", F.sha2("added", 256).alias("added_hash"))


@query(
    f"SELECT request_id, path FROM (SELECT request_id, regexp_replace(regexp_replace(regexp_replace(file_path, '\\\\', '/', 'g'), '^(\\./+)+', ''), '/{{2,}}', '/', 'g') AS path FROM {REQ}) "
    "WHERE NOT regexp_matches(path, '(?:^|/)tests(?:/|$)') AND NOT (regexp_matches(path, '(?:^|/)[^/]*\\.min\\.js(?:/|$)'))"
)
def selected_files(spark, d):
    """Files that the ordered ignore rules leave in."""
    r = requests(spark, d).select("request_id", T.repo_path(F.col("file_path")).alias("path"))
    return r.where(~T.ignored(F.col("path"), ["tests", "*.min.js", "!src/keep.js"]))


ORACLE["selected_files"] = ORACLE["selected_files"].replace("AND NOT (regexp_matches(path, '(?:^|/)[^/]*\\.min\\.js(?:/|$)'))", "AND NOT (regexp_matches(path, '(?:^|/)[^/]*\\.min\\.js(?:/|$)') AND NOT regexp_matches(path, '^src/keep\\.js(?:/|$)'))")


@query(
    f"SELECT request_id, language FROM {REQ} LEFT JOIN (SELECT lower(unnest(extensions)) AS e, language FROM languages) ON e = lower(regexp_extract(file_path, '\\.[^.\\\\/]*$'))"
)
def file_language(spark, d):
    """Extension lookup in a small fixed table: one language for each ending, the first by name."""
    lang = table(spark, d, "languages").select(F.explode("extensions").alias("x"), "language").groupBy(F.lower("x").alias("e")).agg(F.min("language").alias("language"))
    r = requests(spark, d).select("request_id", F.lower(F.regexp_extract("file_path", r"\.[^.\\/]*$", 0)).alias("e"))
    return r.join(lang, "e", "left").select("request_id", "language")


@query(f"SELECT mode, count(*) AS files, count_if(snippet IS NOT NULL AND snippet <> '') AS with_text, sum(length(coalesce(snippet, ''))) AS chars FROM {REQ} GROUP BY mode")
def index_items(spark, d):
    return requests(spark, d).groupBy("mode").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("snippet") != "").alias("with_text"), F.sum(F.length(F.coalesce("snippet", F.lit("")))).alias("chars"))


@query("SELECT doc_id FROM documents WHERE list_has_all(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda x: lower(x)), ['buffer', 'limit'])")
def term_search(spark, d):
    return retrieval.text_search(table(spark, d, "documents"), "doc_id", "text", "Buffer limit")


# Findings


@query(f"SELECT finding_id, issue, reasoning, mitigation, cwe, severity, confidence FROM {NORM}")
def normalised_findings(spark, d):
    return findings(spark, d).select("finding_id", "issue", "reasoning", "mitigation", "cwe", "severity", "confidence")


@query(f"SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM {NORM} GROUP BY severity UNION ALL SELECT 'cwe', cwe, count(*) FROM {NORM} GROUP BY cwe")
def severity_rollup(spark, d):
    return reports.severity_counts(findings(spark, d))


@query(
    f"""SELECT coalesce(file, 'Unknown') AS file, count(*) AS n, count_if(severity = 'Critical') AS critical, count_if(severity = 'High') AS high, count_if(severity = 'Medium') AS medium, count_if(severity = 'Low') AS low,
    CASE max(CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END) WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'Unknown' END AS max_severity FROM {NORM} GROUP BY 1"""
)
def file_histogram(spark, d):
    return reports.file_stats(findings(spark, d))


@query(f"SELECT split_part(coalesce(file, 'Unknown'), '/', 1) AS folder, severity, count(*) AS n FROM {NORM} GROUP BY 1, 2")
def folder_histogram(spark, d):
    return reports.folder_stats(findings(spark, d))


@query(
    f"""SELECT file, string_agg(finding_id::VARCHAR, ',' ORDER BY -(CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END), coalesce(line, 0), encode(issue), finding_id) AS ids FROM {NORM} GROUP BY file"""
)
def grouped_reviews(spark, d):
    return reports.grouped(findings(spark, d)).select("file", F.array_join(F.col("reviews.finding_id").cast("array<string>"), ",").alias("ids"))


@query(f"SELECT min(finding_id) AS finding_id, count(*) AS copies FROM {NORM} GROUP BY issue, reasoning, mitigation, file, severity, cwe")
def unique_findings(spark, d):
    return reports.unique_findings(findings(spark, d), ["issue", "reasoning", "mitigation", "file", "severity", "cwe"], "finding_id")


def _decisions(f: DataFrame) -> DataFrame:
    """Duplicate decisions from the data: findings of a file with the same CWE belong together; every third file's decision names its last finding."""
    g = f.groupBy("file", "cwe").agg(F.array_sort(F.collect_list("finding_id")).alias("members"), F.min("finding_id").alias("decision_no"))
    return g.select("decision_no", "members", F.when(F.col("decision_no") % 3 == 0, F.array_max("members")).alias("representative"))


@query(
    f"SELECT finding_id AS id, CASE WHEN min(finding_id) OVER w % 3 = 0 THEN max(finding_id) OVER w ELSE min(finding_id) OVER w END AS representative FROM {NORM} WINDOW w AS (PARTITION BY file, cwe)"
)
def merged_duplicates(spark, d):
    f = findings(spark, d)
    return reports.merge_groups(spark, f.select(F.col("finding_id").alias("id")), _decisions(f))


@query(
    f"""SELECT a.doc_id AS id, min(b.doc_id) AS component FROM documents a JOIN documents b ON a.repo = b.repo AND a.source = b.source AND a.lang = b.lang GROUP BY a.doc_id
    UNION ALL SELECT doc_id, doc_id FROM documents WHERE repo IS NULL OR source IS NULL OR lang IS NULL"""
)
def components(spark, d):
    """Chains of documents of the same repository, source and language: each linked to the next, as long as the groups are."""
    docs = table(spark, d, "documents").where("repo is not null and source is not null and lang is not null")
    nxt = F.lead("doc_id").over(Window.partitionBy("repo", "source", "lang").orderBy("doc_id"))
    links = docs.select(F.col("doc_id").alias("a"), nxt.alias("b")).where("b is not null")
    return graph.components(spark, table(spark, d, "documents").select(F.col("doc_id").alias("id")), links)


@query(
    f"""WITH one AS (SELECT run_id FROM {NORM} GROUP BY run_id HAVING count(*) = 1), r AS (SELECT run_id, count(DISTINCT record_id) AS records FROM runlog GROUP BY run_id)
    SELECT f.finding_id, r.records FROM {NORM} f LEFT JOIN (SELECT * FROM r WHERE run_id IN (SELECT run_id FROM one)) r USING (run_id)"""
)
def annotated_findings(spark, d):
    notes = source_text.once(table(spark, d, "runlog").select("record_id", "run_id"), "record_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("records"))
    return reports.annotate(findings(spark, d), notes, "run_id").select("finding_id", "records")


_SARIF = r"""x AS (SELECT DISTINCT ON (report_id) report_id, ltrim(payload, chr(65279)) AS p FROM sarif_reports),
    y AS (SELECT report_id, CASE WHEN starts_with(p, '"') AND json_valid(p) THEN ltrim(CASE WHEN json_valid(p) THEN p ELSE 'null' END ->> '$', chr(65279)) ELSE p END AS p FROM x),
    v AS (SELECT report_id, p::JSON AS v FROM (SELECT report_id, CASE WHEN json_valid(p) THEN p ELSE 'null' END AS p FROM y) WHERE json_type(p) = 'OBJECT'),
    r AS (SELECT report_id, unnest(l) AS run, unnest(range(len(l))) AS run_index FROM (SELECT report_id, json_extract(v, '$.runs[*]') AS l FROM v WHERE json_type(v, '$.runs') = 'ARRAY')),
    t AS (SELECT report_id, run_index, run, unnest(l) AS r, unnest(range(len(l))) AS result_index FROM (SELECT *, json_extract(run, '$.results[*]') AS l FROM r WHERE json_type(run, '$.results') = 'ARRAY'))"""


@query(
    rf"""WITH {_SARIF} SELECT report_id, run_index::INT AS run_index, result_index::INT AS result_index, coalesce(r ->> '$.ruleId', '') AS rule_id,
    coalesce(CASE WHEN json_type(r, '$.message') = 'OBJECT' THEN r ->> '$.message.text' ELSE r ->> '$.message' END, '') AS message,
    coalesce(r ->> '$.locations[0].physicalLocation.artifactLocation.uri', '') AS file_path,
    CASE WHEN try_cast(r ->> '$.locations[0].physicalLocation.region.startLine' AS INT) > 0 THEN try_cast(r ->> '$.locations[0].physicalLocation.region.startLine' AS INT) ELSE 1 END AS line,
    coalesce(r ->> '$.locations[0].physicalLocation.region.snippet.text', '') AS snippet,
    CASE WHEN trim(coalesce(run ->> '$.tool.driver.name', '')) <> '' THEN trim(run ->> '$.tool.driver.name') ELSE trim(coalesce(run ->> '$.tool.driver.fullName', '')) END AS source_tool
    FROM t WHERE json_type(r) = 'OBJECT' AND coalesce(try_cast(r ->> '$.properties.triaged' AS BOOLEAN), false) IS NOT TRUE"""
)
def sarif_flatten(spark, d):
    return reports.sarif_findings(source_text.once(table(spark, d, "sarif_reports"), "report_id"))


@query()
def sarif_results(spark, d):
    n = lines(spark, d).groupBy("request_id").agg(F.max("line").alias("n_lines"))
    files = requests(spark, d).select("request_id", "repo", F.col("file_path").alias("file")).join(n, "request_id").groupBy("file").agg(F.max("n_lines").alias("n_lines"))
    return reports.sarif_results(findings(spark, d), files)


_USAGE = r"""(SELECT DISTINCT ON (record_id) run_id AS scope_id, json_extract_string(a, '$.model') AS model, json_extract_string(a, '$.operation') AS operation,
  json_extract_string(a, '$.input_tokens')::BIGINT AS i, json_extract_string(a, '$.output_tokens')::BIGINT AS o, json_extract_string(a, '$.total_tokens')::BIGINT AS t
  FROM (SELECT record_id, run_id, CASE WHEN json_valid(x) AND json_type(CASE WHEN json_valid(x) THEN x ELSE 'null' END) = 'VARCHAR' THEN ltrim(json_extract_string(CASE WHEN json_valid(x) THEN x ELSE 'null' END, '$'), chr(65279)) ELSE x END AS a
    FROM (SELECT record_id, run_id, ltrim(attributes, chr(65279)) AS x FROM runlog WHERE record = 'event' AND name = 'usage'))
  WHERE json_type(CASE WHEN json_valid(a) THEN a ELSE 'null' END) = 'OBJECT' ORDER BY record_id)"""
_USAGE_CLEAN = f"(SELECT scope_id AS scope, coalesce(model, 'unknown') AS model, coalesce(operation, 'llm') AS operation, greatest(coalesce(i, 0), 0) AS i, greatest(coalesce(o, 0), 0) AS o, greatest(coalesce(t, coalesce(i, 0) + coalesce(o, 0)), 0) AS t FROM {_USAGE})"


def _usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage events; attributes may be encoded twice or start with a byte-order mark."""
    plain = lambda c: F.regexp_replace(c, "^\\ufeff+", "")
    u = table(spark, d, "runlog").where("record = 'event' and name = 'usage'").select("record_id", "run_id", F.try_parse_json(plain("attributes")).alias("v"))
    v = F.when(F.schema_of_variant("v") == "STRING", F.try_parse_json(plain(F.try_variant_get("v", "$", "string")))).otherwise(F.col("v"))
    u = u.select("record_id", "run_id", v.alias("a")).where(F.schema_of_variant("a").startswith("OBJECT"))
    get = lambda k, t: F.try_variant_get("a", f"$.{k}", t).alias(k)
    return source_text.once(u.select("record_id", F.col("run_id").alias("scope_id"), get("model", "string"), get("operation", "string"), get("input_tokens", "bigint"), get("output_tokens", "bigint"), get("total_tokens", "bigint")), "record_id")


@query(
    f"SELECT scope, model, operation, grouping(scope, model, operation) AS grouping, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(t)::BIGINT AS total_tokens FROM {_USAGE_CLEAN} GROUP BY GROUPING SETS ((scope), (scope, model), (scope, operation), (model), (operation), ()) HAVING grouping(scope, model, operation) >= 4 OR scope IS NOT NULL"
)
def usage_grouping_sets(spark, d):
    return reports.usage_totals(_usage(spark, d))


@query(f"SELECT operation, t AS total_tokens, row_number() OVER (ORDER BY t DESC, operation) AS rank FROM (SELECT operation, sum(t)::BIGINT AS t FROM {_USAGE_CLEAN} GROUP BY operation) WHERE t > 0")
def usage_by_operation(spark, d):
    return reports.operation_report(reports.usage_totals(_usage(spark, d)))


# Graph

_NODES = """(SELECT DISTINCT ON (graph_revision, position) repo, identity AS id, json_extract_string(payload, '$.file_path') AS file_path, json_extract_string(payload, '$.name') AS name,
  json_extract_string(payload, '$.calls[*]') AS calls, json_extract_string(payload, '$.is_source') = 'true' AS is_source, json_extract_string(payload, '$.is_sink') = 'true' AS is_sink
  FROM codegraph_records JOIN (SELECT repo, max(graph_revision) AS graph_revision FROM codegraph_records GROUP BY repo) USING (repo, graph_revision) WHERE kind = 'node' ORDER BY graph_revision, position)"""
_CALLS = f"""(SELECT repo, caller, symbol, callee, CASE WHEN n = 0 THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution FROM (
  SELECT *, count(callee) OVER (PARTITION BY repo, caller, symbol) AS n FROM (
    SELECT *, max(near) OVER (PARTITION BY repo, caller, symbol) AS best FROM (
      SELECT c.repo, c.caller, c.symbol, t.id AS callee, coalesce((c.file_path = t.file_path)::INT, 0) AS near
      FROM (SELECT DISTINCT repo, id AS caller, file_path, unnest(calls) AS symbol FROM {_NODES}) c LEFT JOIN {_NODES} t ON t.repo = c.repo AND t.name = c.symbol)) WHERE near = best))"""
_EDGES = f"(SELECT DISTINCT repo, caller AS src, callee AS dst FROM {_CALLS} WHERE callee IS NOT NULL)"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(graph.latest_revision(table(spark, d, "codegraph_records")))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(graph.resolve_calls(_nodes(spark, d)))


@query(f"SELECT repo, caller, symbol, callee, resolution FROM {_CALLS}")
def call_resolution(spark, d):
    return graph.resolve_calls(_nodes(spark, d))


_SPANS = """(SELECT DISTINCT run_id AS repo, parent_span_id AS src, span_id AS dst FROM runlog
  WHERE record IN ('span.start', 'span.end') AND run_id IS NOT NULL AND coalesce(span_id, '') <> '' AND parent_span_id <> '')"""


def _span_edges(spark: SparkSession, d: str) -> DataFrame:
    """The call graph of the traces: each span is called by its parent."""
    return hierarchy.span_edges(table(spark, d, "runlog")).select(F.col("run_id").alias("repo"), F.col("parent").alias("src"), F.col("span_id").alias("dst"))


@query(f"SELECT repo, src AS dst, string_agg(dst, '|' ORDER BY dst) AS callers, count(*) AS n_callers FROM {_SPANS} GROUP BY repo, src")
def reverse_calls(spark, d):
    """The children of each span: its edges turned round."""
    turned = _span_edges(spark, d).select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reverse_edges(turned).select("repo", "dst", F.array_join("callers", "|").alias("callers"), "n_callers")


@query(f"SELECT repo, id FROM {_NODES} n WHERE NOT EXISTS (SELECT 1 FROM {_EDGES} e WHERE e.repo = n.repo AND e.dst = n.id AND e.src <> e.dst)")
def no_caller_sources(spark, d):
    return graph.automatic_sources(_nodes(spark, d), _edges(spark, d))


_SINKS = ", ".join(f"('{c}', '{k}')" for k, cs in T.SINK_CALLS.items() for c in cs.split())


@query(
    rf"""WITH c AS (SELECT DISTINCT repo, file_path AS id, lower(unnest(regexp_extract_all(snippet, '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1))) AS call FROM {REQ} WHERE snippet IS NOT NULL), k(call, sink_type) AS (VALUES {_SINKS})
    SELECT repo, id, call, sink_type FROM c JOIN k USING (call) QUALIFY row_number() OVER (PARTITION BY repo, id ORDER BY call) = 1"""
)
def external_sinks(spark, d):
    """Files as nodes of a graph: the first sensitive outside function, by name, that each calls."""
    calls = F.regexp_extract_all("snippet", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1)
    n = requests(spark, d).where("snippet is not null").select("repo", F.col("file_path").alias("id"), "file_path", F.concat(F.lit("file "), "file_path").alias("name"), F.transform(calls, F.lower).alias("calls"))
    return graph.external_sinks(graph.resolve_calls(n), T.SINK_CALLS)


@query(f"SELECT n.repo, count(DISTINCT n.id) AS nodes, (SELECT count(*) FROM {_EDGES} e WHERE e.repo = n.repo) AS edges FROM {_NODES} n GROUP BY n.repo")
def graph_counts(spark, d):
    e = _edges(spark, d).groupBy("repo").agg(F.count(F.lit(1)).alias("edges"))
    return _nodes(spark, d).groupBy("repo").agg(F.countDistinct("id").alias("nodes")).join(e, "repo", "left").select("repo", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_SPANS}), g AS MATERIALIZED (SELECT DISTINCT run_id AS repo, span_id AS id FROM runlog WHERE status = 'error' AND record = 'span.end'),
    t AS (SELECT DISTINCT repo, src AS id FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.repo = e.repo AND x.dst = e.src)),
    w AS (SELECT repo, id AS start, id AS node, 0 AS hops FROM t UNION SELECT w.repo, w.start, e.dst, w.hops + 1 FROM w JOIN e ON e.repo = w.repo AND e.src = w.node WHERE w.hops < 24)
    SELECT w.repo, start, node AS goal, min(hops) AS hops FROM w JOIN g ON g.repo = w.repo AND g.id = w.node GROUP BY ALL"""
)
def source_sink_routes(spark, d):
    """From every root of the traces to the failed spans below it."""
    e = _span_edges(spark, d)
    roots = e.select("repo", F.col("src").alias("id")).distinct().join(e.select("repo", F.col("dst").alias("id")), ["repo", "id"], "left_anti")
    failed = table(spark, d, "runlog").where("record = 'span.end' and status = 'error'").select(F.col("run_id").alias("repo"), F.col("span_id").alias("id"))
    return graph.shortest_routes(spark, e, roots, failed).select("repo", "start", "goal", "hops")


@query(
    f"""WITH s AS (SELECT id, repo, file, start_line, end_line FROM (SELECT DISTINCT finding_id AS id, repo, file, start_line, end_line FROM {FIND} WHERE start_line IS NOT NULL AND end_line IS NOT NULL)),
    m AS (SELECT f.finding_id AS place_id, s.id, s.start_line FROM {FIND} f JOIN s ON s.repo = f.repo AND s.file = f.file WHERE f.line BETWEEN s.start_line AND s.end_line)
    SELECT place_id, min(id) AS id FROM m WHERE start_line = (SELECT max(start_line) FROM m k WHERE k.place_id = m.place_id) GROUP BY place_id"""
)
def enclosing_spans(spark, d):
    f = source_text.once(table(spark, d, "review_findings"), "finding_id")
    spans = f.where("start_line is not null and end_line is not null").select(F.col("finding_id").alias("id"), "repo", "file", "start_line", "end_line")
    return graph.enclosing(spans, f.select(F.col("finding_id").alias("place_id"), "repo", "file", "line"))


@query(
    """WITH p AS (SELECT l_partkey, l_suppkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem),
    b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS v FROM p QUALIFY v <= 2),
    l AS (SELECT *, min(struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber)) OVER (PARTITION BY l_partkey, l_suppkey) AS lead FROM b),
    g AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY v, lead) AS turn FROM l QUALIFY turn <= 3),
    h AS (SELECT *, min(CASE WHEN turn = 1 THEN struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber) END) OVER (PARTITION BY l_partkey) AS head FROM g)
    SELECT l_partkey, l_suppkey, l_shipdate, l_orderkey, l_linenumber, row_number() OVER (ORDER BY turn, head) AS pick FROM h ORDER BY pick LIMIT 500"""
)
def diverse_paths(spark, d):
    p = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return graph.diverse(p, "l_partkey", "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], 2, 3, 500)


# Retrieval and stores


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
    SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5"""
)
def topk_cosine(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.nearest(e.where("vec_id % 20 = 0"), e, 5)


_TRIM = f"length(regexp_replace(coalesce(text, ''), '^{S}+|{S}+$', '', 'g'))"


@query(
    f"""WITH p AS (SELECT source, doc_id, {_TRIM} AS size FROM documents), r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p WHERE size > 0)
    SELECT source, doc_id, least(size, 7000 - b)::BIGINT AS taken, size > 7000 - b AS truncated FROM r WHERE b < 7000"""
)
def budgeted_context(spark, d):
    return retrieval.budgeted(table(spark, d, "documents"), "source", "doc_id", "text", 7000)


@query(
    """SELECT container, capacity_tokens - docs AS code_chars, docs AS docs_chars FROM (SELECT container, capacity_tokens, CASE WHEN capacity_tokens <= 1 THEN 0 ELSE greatest(1, least(round_even(capacity_tokens * 0.37::DOUBLE, 0), capacity_tokens - 1))::BIGINT END AS docs FROM pack_sizes)"""
)
def budget_split(spark, d):
    code, docs = retrieval.split_budget(F.col("capacity_tokens"), F.lit(0.37))
    return table(spark, d, "pack_sizes").select("container", code.cast("bigint").alias("code_chars"), docs.cast("bigint").alias("docs_chars"))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def json_path_filter(spark, d):
    return retrieval.json_equals(table(spark, d, "events"), "props", {"k": "7"}).select("event_id")


@query(
    """SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) AS value, coalesce(o.d, 'new') AS created_at, CASE WHEN n.o_orderkey IS NULL THEN o.d ELSE 'new' END AS updated_at
    FROM (SELECT *, 'old' AS d FROM orders WHERE o_orderkey % 2 = 0) o FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) n ON n.o_orderkey = o.o_orderkey"""
)
def upsert_merge(spark, d):
    """Old rows: even keys; new rows: keys divisible by three. The sets are the two sides of the merge."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    old = o.where("o_orderkey % 2 = 0").withColumns({"created_at": F.lit("old"), "updated_at": F.lit("old")})
    return retrieval.upsert(old, o.where("o_orderkey % 3 = 0").withColumn("now", F.lit("new")), ["o_orderkey"])


@query("SELECT doc_id, lang, source FROM documents WHERE lang IS DISTINCT FROM 'en' OR source IS DISTINCT FROM 'repo_source'")
def stale_records(spark, d):
    return retrieval.stale(table(spark, d, "documents"), {"lang": "en", "source": "repo_source"}).select("doc_id", "lang", "source")


@query("SELECT DISTINCT list_aggregate(string_split(repo, '/')[1:1], 'string_agg', '/') AS namespace FROM documents WHERE repo IS NOT NULL")
def namespaces(spark, d):
    return table(spark, d, "documents").where("repo is not null").select(F.array_join(F.slice(F.split("repo", "/"), 1, 1), "/").alias("namespace")).distinct()


@query(
    f"""WITH a AS (SELECT DISTINCT regexp_extract(file, '[^/\\\\]+$') AS name FROM {FIND} WHERE finding_id % 20 = 0)
    SELECT name, request_id, row_number() OVER (PARTITION BY name ORDER BY lower(file_path), file_path, request_id) AS place FROM {REQ} JOIN a ON name = regexp_extract(file_path, '[^/\\\\]+$') QUALIFY place <= 20"""
)
def find_names(spark, d):
    """The files of exactly the names asked for, at most twenty a name, by path whatever its case: the limit is the feature. Asked: the files of every twentieth finding."""
    name = lambda c: F.regexp_extract(c, r"[^/\\]+$", 0)
    asked = source_text.once(table(spark, d, "review_findings"), "finding_id").where("finding_id % 20 = 0").select(name("file").alias("name")).distinct()
    r = requests(spark, d).select("request_id", "file_path", name("file_path").alias("name")).join(asked, "name")
    w = Window.partitionBy("name").orderBy(F.lower("file_path"), "file_path", "request_id")
    return r.withColumn("place", F.row_number().over(w)).where("place <= 20").select("name", "request_id", "place")


# Facts from C and C++


def _c_files(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).where(F.lower("file_path").rlike(r"\.(c|h|cc|cpp|cxx|hpp)$"))


@query()
def c_facts_table(spark, d):
    return c_facts.extract(_c_files(spark, d))


@query()
def c_links(spark, d):
    f = _c_files(spark, d)
    return c_facts.link(c_facts.extract(f), f)


@query()
def c_sinks(spark, d):
    return c_facts.sinks(c_facts.extract(_c_files(spark, d)), T.SINK_CALLS)


# Traces

_LOG = "(SELECT DISTINCT ON (record_id) * FROM runlog WHERE run_id IS NOT NULL AND record_id IS NOT NULL ORDER BY record_id)"


@query(
    f"""WITH r AS MATERIALIZED (SELECT * FROM {_LOG}),
    s0 AS (SELECT run_id, span_id, count_if(record = 'span.start') AS starts, count_if(record = 'span.end') AS ends, max(CASE WHEN record = 'span.start' THEN seq END) AS s_seq, max(CASE WHEN record = 'span.end' THEN seq END) AS e_seq,
      max(CASE WHEN parent_span_id <> '' THEN parent_span_id END) AS parent, count_if(record = 'span.start' AND kind = 'run') AS run_starts,
      greatest(count(DISTINCT coalesce(kind, '')), count(DISTINCT coalesce(name, '')), count(DISTINCT coalesce(parent_span_id, ''))) AS d,
      count_if(record = 'span.end' AND coalesce(status, '') NOT IN ('ok', 'error', 'cancelled', 'inconclusive')) AS bs, count_if(record = 'span.end' AND NOT coalesce(duration_ms >= 0, false)) AS bd
      FROM r WHERE record IN ('span.start', 'span.end') AND span_id IS NOT NULL GROUP BY run_id, span_id),
    s AS (SELECT a.*, b.span_id AS known, b.e_seq AS p_end FROM s0 a LEFT JOIN s0 b ON b.run_id = a.run_id AND b.span_id = a.parent),
    v AS (SELECT run_id, 'no_start' AS rule FROM s WHERE starts = 0 UNION ALL SELECT run_id, 'no_end' FROM s WHERE ends = 0 UNION ALL SELECT run_id, 'many_starts' FROM s WHERE starts > 1 UNION ALL SELECT run_id, 'many_ends' FROM s WHERE ends > 1
      UNION ALL SELECT run_id, 'unknown_parent' FROM s WHERE parent IS NOT NULL AND known IS NULL UNION ALL SELECT run_id, 'ends_after_parent' FROM s WHERE e_seq > p_end
      UNION ALL SELECT run_id, 'unstable' FROM s WHERE starts > 0 AND ends > 0 AND d > 1 UNION ALL SELECT run_id, 'bad_status' FROM s WHERE bs > 0 UNION ALL SELECT run_id, 'bad_duration' FROM s WHERE bd > 0
      UNION ALL SELECT run_id, 'roots' FROM s GROUP BY run_id HAVING sum(run_starts) <> 1
      UNION ALL SELECT run_id, 'seq_gap' FROM (SELECT run_id, seq, min(seq) OVER (PARTITION BY run_id) AS f FROM r) x WHERE seq > f AND NOT EXISTS (SELECT 1 FROM r y WHERE y.run_id = x.run_id AND y.seq = x.seq - 1)
      UNION ALL SELECT e.run_id, 'event_outside' FROM (SELECT * FROM r WHERE record = 'event') e LEFT JOIN s ON s.run_id = e.run_id AND s.span_id = e.span_id WHERE coalesce(starts, 0) = 0 OR e.seq < s_seq OR e.seq > e_seq)
    SELECT run_id, rule, count(*) AS n FROM v GROUP BY run_id, rule"""
)
def trace_violations(spark, d):
    return trace.violations(table(spark, d, "runlog"))


@query(f"SELECT run_id, count(*) AS records, count(DISTINCT CASE WHEN record = 'span.start' THEN span_id END) AS spans, count_if(record = 'event') AS events, count_if(record = 'span.end' AND status = 'error') AS failed FROM {_LOG} GROUP BY run_id")
def trace_summary(spark, d):
    return trace.summary(table(spark, d, "runlog"))


@query(
    "WITH s AS (SELECT run_id, span_id, any_value(kind) AS kind, any_value(name) AS name FROM runlog WHERE record = 'span.start' GROUP BY ALL), e AS (SELECT run_id, span_id, any_value(status) AS status, any_value(duration_ms) AS duration_ms FROM runlog WHERE record = 'span.end' GROUP BY run_id, span_id) "
    "SELECT run_id, span_id, kind, name, status, duration_ms FROM s JOIN e USING (run_id, span_id)"
)
def stream_spans(spark, d):
    """Extension: spans paired by a stateful stream."""
    return trace.drain(spark, trace.paired_spans(trace.read_stream(spark, f"{d}/runlog.parquet")))


@query("SELECT event_type, epoch_us(date_trunc('hour', ts))::BIGINT AS window_us, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_window_counts(spark, d):
    """Extension: hourly windows of events, counted by a stream; every event and every window."""
    s = trace.read_stream(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return trace.drain_whole(spark, trace.window_counts(s, "ts", "event_type")).select("event_type", F.unix_micros("window_start").alias("window_us"), "n")


# Evidence


@query()
def model_json(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", evidence.json_text(F.col("text")).alias("json_text"))


@query()
def canonical_attributes(spark, d):
    log = source_text.once(table(spark, d, "runlog").select("record_id", "attributes"), "record_id")
    c = evidence.with_python(log, "record_id", "attributes", evidence.canonical, "string", "canonical")
    return c.where("canonical is not null").select("record_id", F.sha2("canonical", 256).alias("json_hash"))


@query()
def redacted_attributes(spark, d):
    log = source_text.once(table(spark, d, "runlog").select("record_id", "attributes"), "record_id")
    return evidence.with_python(log, "record_id", "attributes", lambda t: evidence.redacted(t)[0], "string", "attributes_safe")


@query()
def redacted_blobs(spark, d):
    """The long strings that the references in `redacted_attributes` name, by digest."""
    return evidence.blobs(source_text.once(table(spark, d, "runlog").select("record_id", "attributes"), "record_id"), "attributes")


_PHRASES = lambda xs: "|".join(x.replace(" ", "\\s+") for x in xs if x != "contradict")
_PROSE = "lower(concat_ws(chr(10), coalesce(issue, ''), coalesce(reasoning, ''), coalesce(mitigation, '')))"


@query(
    f"""SELECT finding_id, regexp_matches(t, '(^|[^a-z0-9_])({_PHRASES(evidence.CONTRADICTIONS)})($|[^a-z0-9_])') OR regexp_matches(regexp_replace(t, '\\b(not|no)\\s+contradict(s|ed|ing|ion|ory)?\\b', '', 'g'), '\\bcontradict(s|ed|ing|ion|ory)?\\b') AS contradicted,
    regexp_matches(t, '(^|[^a-z0-9_])({_PHRASES(evidence.UNCERTAINTIES)})($|[^a-z0-9_])') AS uncertain FROM (SELECT finding_id, {_PROSE} AS t FROM {FIND})"""
)
def prose_signals(spark, d):
    """Every finding, and whether its texts speak against it or leave it open."""
    f = source_text.once(table(spark, d, "review_findings"), "finding_id")
    t = F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in ("issue", "reasoning", "mitigation")))
    return f.select("finding_id", evidence.signalled(t, evidence.CONTRADICTIONS).alias("contradicted"), evidence.signalled(t, evidence.UNCERTAINTIES).alias("uncertain"))


@query(f"SELECT min(finding_id) AS finding_id, count(*) AS claims, arg_min(issue, finding_id) AS issue, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos FROM (SELECT *, lower(regexp_replace(issue, '{S}+', ' ', 'g')) AS k FROM {NORM}) GROUP BY k, severity")
def merged_claims(spark, d):
    f = findings(spark, d).select("finding_id", "issue", "severity", F.array("repo").alias("repos"))
    return evidence.fresh_claims(f, "issue", ["severity"], ["repos"], "finding_id").select("finding_id", "claims", "issue", F.array_join("repos", ",").alias("repos"))


@query(f"SELECT finding_id FROM {FIND} WHERE NOT coalesce(regexp_matches(file, '^tests/.*$') AND NOT regexp_matches(file, '^tests/[^/]*/.*\\.py$'), false)")
def in_scope_findings(spark, d):
    f = source_text.once(table(spark, d, "review_findings"), "finding_id")
    return evidence.in_scope(f, "file", [("tests/*/**.py", False), ("tests/**", True)]).select("finding_id")


@query(f"WITH a AS (SELECT finding_id, cwe, bool_or(coalesce(confidence < 0.5, false)) AS gone FROM {FIND} GROUP BY finding_id, cwe) SELECT finding_id FROM a GROUP BY finding_id HAVING NOT bool_and(gone)")
def admitted_findings(spark, d):
    f = source_text.once(table(spark, d, "review_findings"), "finding_id")
    return evidence.admitted(f.select("finding_id", F.col("cwe").alias("alternative"), (F.col("confidence") < 0.5).alias("contradicted")))


@query()
def review_batches(spark, d):
    f = findings(spark, d).select("file", "finding_id", T.token_estimate(F.concat_ws(" ", "issue", "reasoning", "mitigation"), 4.0).alias("tokens"))
    return evidence.batches(f, "file", "finding_id", "tokens", 2000)


@query(
    f"SELECT f.finding_id AS id, max_by(r.record_id, struct_pack(a := r.ts, b := r.record_id)) AS record_id FROM {FIND} f LEFT JOIN {_LOG} r ON r.run_id = f.run_id AND r.ts <= f.created_at GROUP BY f.finding_id"
)
def last_record_before(spark, d):
    """The last trace record of its run before each finding was made: an as-of join."""
    log = source_text.once(table(spark, d, "runlog").where("run_id is not null and record_id is not null").select("record_id", "run_id", "ts"), "record_id")
    last = log.groupBy("run_id", "ts").agg(F.max("record_id").alias("record_id"))
    f = source_text.once(table(spark, d, "review_findings"), "finding_id").select(F.col("finding_id").alias("id"), "run_id", F.col("created_at").alias("ts"))
    return evidence.latest_before(f, last, ["run_id"], "ts", "record_id").select("id", "record_id")


_CELL = lambda c: f"coalesce(to_json({c}::VARCHAR)::VARCHAR, 'null')"


@query(
    f"""SELECT repo, {_MULTISET('h')} AS fingerprint FROM (SELECT n.repo, sha256('{{"id":' || {_CELL('id')} || ',"name":' || {_CELL('name')} || ',"line":' || {_CELL('line')} || ',"is_source":' || {_CELL('is_source')} || ',"is_sink":' || {_CELL('is_sink')} || '}}') AS h
    FROM (SELECT n.*, l.line FROM {_NODES} n JOIN (SELECT DISTINCT repo, identity AS id, json_extract_string(payload, '$.line_number') AS line FROM codegraph_records JOIN (SELECT repo, max(graph_revision) AS graph_revision FROM codegraph_records GROUP BY repo) USING (repo, graph_revision) WHERE kind = 'node') l USING (repo, id)) n) GROUP BY repo"""
)
def graph_fingerprint(spark, d):
    return evidence.table_fingerprint(_nodes(spark, d), "repo", ["id", "name", "line", "is_source", "is_sink"])


def _listed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return graph.latest_revision(table(spark, d, "codegraph_records")).where(F.col("kind") == kind).select("repo", F.col("identity").alias("file_path"))


_LAST = "(SELECT DISTINCT repo, kind, identity AS file_path FROM codegraph_records JOIN (SELECT repo, max(graph_revision) AS graph_revision FROM codegraph_records GROUP BY repo) USING (repo, graph_revision))"


@query(
    f"""WITH n AS (SELECT run_id AS repo, span_id AS id, record_id, name FROM (SELECT DISTINCT ON (record_id) * FROM runlog WHERE record = 'span.start' AND run_id IS NOT NULL AND span_id IS NOT NULL)), e AS (SELECT DISTINCT * FROM {_SPANS})
    SELECT repo, 'unknown_target' AS problem, count(*) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.repo = e.repo AND n.id = e.src) GROUP BY repo
    UNION ALL SELECT repo, 'duplicate_id', count(*) FROM (SELECT repo, id FROM n GROUP BY repo, id HAVING count(*) > 1) GROUP BY repo
    UNION ALL SELECT repo, 'unprocessed_file', count(*) FROM n WHERE name NOT IN (SELECT DISTINCT name FROM runlog WHERE record = 'event' AND name IS NOT NULL) GROUP BY repo"""
)
def graph_validation(spark, d):
    """The traces as graphs: spans that a parent's name leads to nothing for, that start twice, or whose name no event has."""
    log = source_text.once(table(spark, d, "runlog").where("record = 'span.start' and run_id is not null and span_id is not null"), "record_id")
    n = log.select(F.col("run_id").alias("repo"), F.col("span_id").alias("id"), F.col("name").alias("file_path"))
    e = _span_edges(spark, d).select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))
    named = table(spark, d, "runlog").where("record = 'event' and name is not null").select(F.col("name").alias("file_path")).distinct()
    return evidence.graph_problems(n, e, n.join(named, "file_path", "left_semi").select("repo", "file_path"))


@query(
    f"""WITH a AS (SELECT DISTINCT repo, file_path FROM {REQ} WHERE regexp_matches(lower(file_path), '\\.(c|h|cc|cpp|cxx|hpp)$')), p AS (SELECT repo, file_path FROM {_LAST} WHERE kind = 'processed'), f AS (SELECT repo, file_path FROM {_LAST} WHERE kind = 'failed'),
    k AS (SELECT * FROM a UNION SELECT * FROM p UNION SELECT * FROM f),
    m AS (SELECT k.*, CASE WHEN p.repo IS NOT NULL AND f.repo IS NOT NULL THEN 'both' WHEN a.repo IS NULL THEN 'unasked' WHEN p.repo IS NULL AND f.repo IS NULL THEN 'missing' END AS problem
      FROM k LEFT JOIN a USING (repo, file_path) LEFT JOIN p USING (repo, file_path) LEFT JOIN f USING (repo, file_path)) SELECT * FROM m WHERE problem IS NOT NULL"""
)
def build_coverage(spark, d):
    asked = _c_files(spark, d).select("repo", "file_path")
    return evidence.coverage(_listed(spark, d, "processed"), _listed(spark, d, "failed"), asked)


@query(
    r"""WITH x AS (SELECT DISTINCT ON (report_id) report_id, ltrim(payload, chr(65279)) AS p FROM sarif_reports), v AS (SELECT report_id, coalesce(json_valid(p), false) AS ok, CASE WHEN json_valid(p) THEN p ELSE 'null' END AS p FROM x)
    SELECT report_id, 'not_json' AS problem FROM v WHERE NOT ok UNION ALL SELECT report_id, 'not_an_object' FROM v WHERE ok AND json_type(p) <> 'OBJECT'
    UNION ALL SELECT report_id, 'version' FROM v WHERE json_type(p) = 'OBJECT' AND coalesce(p ->> '$.version', '') <> '2.1.0' UNION ALL SELECT report_id, 'no_runs' FROM v WHERE json_type(p) = 'OBJECT' AND coalesce(json_type(p, '$.runs'), '') <> 'ARRAY'"""
)
def sarif_validation(spark, d):
    return evidence.sarif_problems(source_text.once(table(spark, d, "sarif_reports"), "report_id"))


# Upkeep


@query(f"SELECT request_id FROM {REQ} q WHERE NOT EXISTS (SELECT 1 FROM review_findings f WHERE f.repo = q.repo AND f.file = q.file_path)")
def remaining_work(spark, d):
    """Files that no finding speaks of: what a resumed run still has to do."""
    done = table(spark, d, "review_findings").select("repo", F.col("file").alias("file_path")).distinct()
    return requests(spark, d).join(done, ["repo", "file_path"], "left_anti").select("request_id")


@query(f"SELECT request_id, min(request_id) OVER (PARTITION BY sha256(snippet)) AS representative FROM {REQ} WHERE snippet IS NOT NULL")
def unique_requests(spark, d):
    """Equal texts are worked on once, under the least id, and the answer fans out to the others: aggregate, then join back."""
    h = requests(spark, d).where("snippet is not null").select("request_id", F.sha2("snippet", 256).alias("h"))
    return h.join(h.groupBy("h").agg(F.min("request_id").alias("representative")), "h").select("request_id", "representative")


@query(f"SELECT request_id, repo, file_path FROM {REQ} ORDER BY encode(repo), encode(file_path), request_id LIMIT 50 OFFSET 100")
def record_page(spark, d):
    """One page of an ordered listing: the limit is the feature."""
    return requests(spark, d).orderBy("repo", "file_path", "request_id").offset(100).limit(50).select("request_id", "repo", "file_path")


@query("SELECT source, sum(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)) END)::BIGINT AS tokens, count(*) AS documents FROM documents GROUP BY source")
def index_tokens(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(T.token_estimate(F.col("text"), 4.0)).alias("tokens"), F.count(F.lit(1)).alias("documents"))


@query(f"SELECT repo, caller, symbol FROM {_CALLS} WHERE resolution = 'unresolved'")
def unresolved_calls(spark, d):
    return graph.resolve_calls(_nodes(spark, d)).where("resolution = 'unresolved'").select("repo", "caller", "symbol")


@query(
    f"""WITH p AS (SELECT DISTINCT repo, identity AS name, unnest(json_extract_string(payload, '$.locations[*]')) AS place FROM codegraph_records JOIN (SELECT repo, max(graph_revision) AS graph_revision FROM codegraph_records GROUP BY repo) USING (repo, graph_revision) WHERE kind = 'declaration'),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY encode(place)) AS n FROM p)
    SELECT n.repo, n.id, (SELECT string_agg(place, '|' ORDER BY r.n) FROM r WHERE r.repo = n.repo AND r.name = n.name AND r.n <= 4) AS places FROM (SELECT DISTINCT repo, id, name FROM {_NODES}) n"""
)
def public_entry_points(spark, d):
    """Each function with the first four places where its name is declared, null where it is nowhere."""
    p = graph.latest_revision(table(spark, d, "codegraph_records")).where("kind = 'declaration'").select("repo", F.col("identity").alias("name"), F.explode(F.from_json("payload", "locations array<string>")["locations"]).alias("place")).distinct()
    first = p.withColumn("n", F.row_number().over(Window.partitionBy("repo", "name").orderBy("place"))).where("n <= 4")
    places = first.groupBy("repo", "name").agg(F.array_join(F.array_sort(F.collect_list("place")), "|").alias("places"))
    return _nodes(spark, d).select("repo", "id", "name").distinct().join(places, ["repo", "name"], "left").select("repo", "id", "places")


@query(f"SELECT DISTINCT repo, id, min(symbol) AS symbol FROM (SELECT repo, id, unnest(calls) AS symbol FROM {_NODES}) WHERE starts_with(lower(symbol), 'release_') GROUP BY repo, id")
def configured_sinks(spark, d):
    """Functions that call a name of a configured family, whatever its case."""
    c = _nodes(spark, d).select("repo", "id", F.explode("calls").alias("symbol")).where(F.lower("symbol").startswith("release_"))
    return c.groupBy("repo", "id").agg(F.min("symbol").alias("symbol"))
