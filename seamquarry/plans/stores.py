"""Queries for sources, stores, sinks, paths and report rows, over whole tables, with the SQL that states the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import c_facts, graph, reports, retrieval, source_text, stores
from ..session import shared_dir, table
from ..sources import files
from . import catalog
from .catalog import FIND, LINES, NORM, REQ, _SPANS, _c_files, _span_edges, findings, requests

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# Sources

_ENDING = "lower(regexp_extract(file_path, '\\.[^.\\\\/]*$'))"


@query(
    f"""SELECT request_id, CASE WHEN {_ENDING} IN ('.md', '.markdown', '.rst', '.txt', '.adoc') THEN 'docs' ELSE 'code' END AS part FROM {REQ}
    WHERE {_ENDING} IN ('.md', '.markdown', '.rst', '.txt', '.adoc') OR {_ENDING} IN (SELECT lower(unnest(extensions)) FROM languages)"""
)
def index_inputs(spark, d):
    return files.index_inputs(requests(spark, d), "file_path", table(spark, d, "languages")).select("request_id", "part")


@query(
    f"""SELECT part, count(*) AS items, sum(length(coalesce(snippet, ''))) AS chars FROM (SELECT snippet, CASE WHEN {_ENDING} IN ('.md', '.markdown', '.rst', '.txt', '.adoc') THEN 'docs' WHEN {_ENDING} IN (SELECT lower(unnest(extensions)) FROM languages) THEN 'code' END AS part FROM {REQ}
    UNION ALL SELECT source, 'docs' FROM (SELECT DISTINCT ON (source_id) * FROM threat_sources) WHERE regexp_matches(lower(path), '\\.(md|markdown|rst|txt|adoc)$')) WHERE part IS NOT NULL GROUP BY part"""
)
def index_item_counts(spark, d):
    """Code files and documentation to be indexed: requests, and the Markdown sources."""
    docs = source_text.once(table(spark, d, "threat_sources"), "source_id").select(F.col("path").alias("file_path"), F.col("source").alias("snippet"))
    both = requests(spark, d).select("file_path", "snippet").unionByName(docs)
    got = files.index_inputs(both, "file_path", table(spark, d, "languages"))
    return got.groupBy("part").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length(F.coalesce("snippet", F.lit("")))).alias("chars"))


@query(f"SELECT request_id, 'work/' || regexp_replace(regexp_replace(regexp_replace(file_path, '\\\\', '/', 'g'), '^(\\./+)+', ''), '/{{2,}}', '/', 'g') AS document_id FROM {REQ}")
def document_ids(spark, d):
    """Documents named from the folder above the code."""
    return requests(spark, d).select("request_id", files.under_parent("/srv/work", T.repo_path(F.col("file_path"))).alias("document_id"))


_RULES = [("c", [".c"], [], 1), ("c_header", [".h", ".hpp"], ["*.h"], 1), ("script", [".js", ".mjs"], [], 1), ("minified", [], ["*.min.js"], 2), ("snake", [".py"], ["test_*"], 0), ("generated", [], ["*_autogen.*"], 0)]


@query(
    f"""SELECT request_id, CASE WHEN {_ENDING} = '.c' THEN 'c' WHEN {_ENDING} IN ('.h', '.hpp') THEN 'c_header' WHEN {_ENDING} IN ('.js', '.mjs') THEN 'script' WHEN {_ENDING} = '.py' THEN 'snake'
    WHEN n LIKE '%.min.js' THEN 'minified' WHEN n LIKE '%.h' THEN 'c_header' WHEN starts_with(n, 'test_') THEN 'snake' WHEN n LIKE '%\\_autogen.%' ESCAPE '\\' THEN 'generated' END AS language
    FROM (SELECT *, lower(regexp_extract(file_path, '[^\\\\/]*$')) AS n FROM {REQ})"""
)
def language_rules(spark, d):
    """Languages by ending, then by patterns on the file's name, the greatest priority first."""
    return requests(spark, d).select("request_id", files.language_of(F.col("file_path"), _RULES).alias("language"))


@query("SELECT source_id, path FROM (SELECT DISTINCT ON (source_id) * FROM threat_sources) WHERE regexp_matches(path, '(?i)^(security/[^/]*\\.md|(.*/)?threats/[^/]*\\.[^/]*)$') AND regexp_matches(lower(path), '\\.(md|rst|txt)$')")
def threat_files(spark, d):
    s = source_text.once(table(spark, d, "threat_sources"), "source_id")
    return files.scanned(s, "path", ["security/*.md", "**/threats/*.*"], [".md", ".rst", ".txt"]).select("source_id", "path")


@query(f"SELECT mode, request_id FROM {REQ} WHERE (mode = 'file' AND snippet <> '') OR (mode = 'dir' AND regexp_matches(file_path, '^(\\./)?(src|lib)/')) OR (mode = 'code' AND {_ENDING} IN (SELECT lower(unnest(extensions)) FROM languages))")
def review_targets(spark, d):
    """What each mode reviews: the named file if it has text, the folders asked for, or every file of a known language."""
    langs = table(spark, d, "languages").select(F.explode("extensions").alias("x")).select(F.lower("x").alias("ending")).distinct().withColumn("known", F.lit(True))
    r = requests(spark, d).withColumn("ending", F.lower(F.regexp_extract("file_path", r"\.[^.\\/]*$", 0))).join(langs, "ending", "left")
    wanted = ((F.col("mode") == "file") & (F.col("snippet") != "")) | ((F.col("mode") == "dir") & F.col("file_path").rlike(r"^(\./)?(src|lib)/")) | ((F.col("mode") == "code") & F.col("known"))
    return r.where(wanted).select("mode", "request_id")


# Text


@query(f"SELECT request_id, max(line) AS line FROM (SELECT l.request_id, l.line FROM ({catalog.ORACLE['line_index']}) l JOIN (SELECT request_id, octet_length(encode(snippet)) // 2 AS at FROM {REQ}) q USING (request_id) WHERE l.start_byte <= q.at) GROUP BY request_id")
def middle_lines(spark, d):
    """The line that holds the middle byte of each file."""
    at = requests(spark, d).select("request_id", F.expr("octet_length(snippet) div 2").alias("at"))
    return source_text.byte_lines(catalog.lines(spark, d), at, "request_id", "at").select("request_id", "line")


@query(f"SELECT finding_id, sha256(concat_ws(chr(31), coalesce(file, ''), coalesce(line::VARCHAR, ''), lower(regexp_replace(issue, '{catalog.S}+', ' ', 'g')))) AS evidence_key FROM {NORM}")
def evidence_keys(spark, d):
    """A key of what a finding says and where, that white space and case don't change."""
    parts = [F.coalesce("file", F.lit("")), F.coalesce(F.col("line").cast("string"), F.lit("")), F.lower(T.fold_space(F.col("issue")))]
    return findings(spark, d).select("finding_id", F.sha2(F.concat_ws("\x1f", *parts), 256).alias("evidence_key"))


@query(
    rf"""WITH f AS (SELECT finding_id, coalesce(code_snippet, '') AS s, coalesce(reasoning, '') AS r FROM {FIND}),
    w AS (SELECT finding_id, 1 AS rank, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS p FROM (SELECT finding_id, regexp_extract_all(s, '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1) AS l FROM f)
      UNION ALL SELECT finding_id, 2, unnest(l), unnest(range(1, len(l) + 1)) FROM (SELECT finding_id, regexp_extract_all(s, '[A-Za-z_][A-Za-z0-9_]*') AS l FROM f)
      UNION ALL SELECT finding_id, 3, unnest(l), unnest(range(1, len(l) + 1)) FROM (SELECT finding_id, regexp_extract_all(r, '[A-Za-z_][A-Za-z0-9_]{{3,}}') AS l FROM f)),
    k AS (SELECT finding_id, w, min(struct_pack(rank := rank, p := p)) AS o FROM w WHERE length(w) <= 64 AND lower(w) NOT IN ({", ".join(f"'{x}'" for x in T.STOP_TERMS)}) GROUP BY finding_id, w),
    n AS (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY o) AS n FROM k)
    SELECT f.finding_id, coalesce(string_agg(w, ' ' ORDER BY n), '') AS symbols FROM f LEFT JOIN n ON n.finding_id = f.finding_id AND n.n <= 8 GROUP BY f.finding_id"""
)
def symbol_candidates(spark, d):
    """The names to look for a finding's code by: what its snippet calls, its other names, then the words of its reasoning."""
    f = source_text.once(table(spark, d, "review_findings"), "finding_id")
    return f.select("finding_id", F.array_join(T.symbols(F.col("code_snippet"), F.col("reasoning"), 8), " ").alias("symbols"))


@query(f"SELECT request_id, path, line FROM (SELECT q.request_id, q.file_path AS path, l.line FROM {LINES} l JOIN {REQ} q USING (request_id) WHERE regexp_matches(l.line_text, 'memcpy\\s*\\(')) ORDER BY lower(path), path, line, request_id LIMIT 100")
def grep_first(spark, d):
    """The first hundred places of a pattern, by path whatever its case and line: the limit is the feature."""
    hits = source_text.grep(catalog.lines(spark, d), r"memcpy\s*\(", "request_id").join(requests(spark, d).select("request_id", F.col("file_path").alias("path")), "request_id")
    return hits.orderBy(F.lower("path"), "path", "line", "request_id").limit(100).select("request_id", "path", "line")


# Reports


@query(f"SELECT finding_id, coalesce(file, '') AS \"File\", coalesce(line, 0) AS \"Line\", severity AS \"Severity\", cwe AS \"CWE\", issue AS \"Issue\", reasoning AS \"Reasoning\", mitigation AS \"Mitigation\" FROM {NORM}")
def report_rows(spark, d):
    return reports.report_rows(findings(spark, d))


@query(f"SELECT finding_id FROM {NORM} WHERE confidence > 0")
def confident_findings(spark, d):
    return findings(spark, d).where("confidence > 0").select("finding_id")


@query(f"SELECT file, count(*) AS kept FROM (SELECT min(finding_id) AS id, file FROM {NORM} GROUP BY issue, reasoning, mitigation, file, severity, cwe) GROUP BY file")
def kept_groups(spark, d):
    """The groups of findings that are left when exact duplicates are taken out; empty groups disappear."""
    f = findings(spark, d)
    keep = reports.unique_findings(f, ["issue", "reasoning", "mitigation", "file", "severity", "cwe"], "finding_id")
    return reports.rebuilt(f, keep, "finding_id").groupBy("file").agg(F.count(F.lit(1)).alias("kept"))


@query(f"SELECT finding_id, regexp_extract(reasoning, '(?i)(?:^|\\n)\\s*Root cause:\\s*([^\\n]*)', 1) AS root_cause FROM {NORM}")
def root_causes(spark, d):
    """The line that a reasoning text marks as the root cause, empty where it has none."""
    return findings(spark, d).select("finding_id", F.regexp_extract("reasoning", r"(?i)(?:^|\n)\s*Root cause:\s*([^\n]*)", 1).alias("root_cause"))


_SCOPES = ["repository", "src/*", "lib", "pkg/mesh/"]


@query(f"SELECT request_id, s AS scope FROM (SELECT request_id, regexp_replace(regexp_replace(regexp_replace(file_path, '\\\\', '/', 'g'), '^(\\./+)+', ''), '/{{2,}}', '/', 'g') AS p FROM {REQ}), (SELECT unnest({_SCOPES}) AS s) WHERE s = 'repository' OR (s = 'src/*' AND regexp_matches(p, '^src/[^/]*$')) OR (s = 'lib' AND (p = 'lib' OR starts_with(p, 'lib/'))) OR (s = 'pkg/mesh/' AND starts_with(p, 'pkg/mesh/'))")
def lesson_scopes(spark, d):
    """Which configured lessons apply to each file: all of the repository's, those whose glob matches, else those of the file or a folder above it."""
    r = requests(spark, d).select("request_id", T.repo_path(F.col("file_path")).alias("path"))
    return r.select("request_id", F.explode(reports.applying(F.col("path"), _SCOPES)).alias("scope"))


@query(
    """WITH s AS (SELECT run_id, span_id, any_value(status) AS status FROM (SELECT DISTINCT run_id, span_id, status FROM runlog WHERE record = 'span.end' AND run_id IS NOT NULL AND span_id IS NOT NULL) GROUP BY run_id, span_id)
    SELECT run_id, count(*) AS ended, CASE WHEN count_if(status = 'ok') = count(*) THEN 'ok' WHEN count_if(status = 'ok') > 0 THEN 'inconclusive' ELSE 'failed' END AS status FROM s GROUP BY run_id"""
)
def run_status(spark, d):
    """Each run's status from its spans': all well, some, or none."""
    ends = table(spark, d, "runlog").where("record = 'span.end' and run_id is not null and span_id is not null").select("run_id", "span_id", "status").dropDuplicates(["run_id", "span_id"])
    return reports.folded_status(ends, "run_id", "status")


# Stores


def _records(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("repo is not null")
    return docs.select(F.split("repo", "/").alias("namespace"), F.col("doc_id").cast("string").alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("value"), "doc_id", "lang")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS value FROM documents WHERE repo IS NOT NULL AND doc_id IN (SELECT request_id FROM review_requests)")
def records_by_key(spark, d):
    keys = table(spark, d, "review_requests").select(F.col("request_id").cast("string").alias("key"))
    return stores.fetched(_records(spark, d), keys, ["key"]).select("doc_id", "value")


@query("SELECT doc_id FROM documents WHERE repo IS NOT NULL AND doc_id NOT IN (SELECT request_id FROM review_requests)")
def records_left(spark, d):
    keys = table(spark, d, "review_requests").select(F.col("request_id").cast("string").alias("key"))
    return stores.deleted(_records(spark, d), keys, ["key"]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE repo IS NOT NULL AND lang = 'en'")
def fresh_records(spark, d):
    """The store without its stale records."""
    return stores.without_stale(_records(spark, d), {"lang": "en"}, "key").select("doc_id")


@query("SELECT DISTINCT string_agg(p, '/') AS namespace FROM (SELECT repo, unnest(string_split(repo, '/')[1:2]) AS p, unnest(range(1, len(string_split(repo, '/')[1:2]) + 1)) AS i FROM (SELECT DISTINCT repo FROM documents WHERE repo IS NOT NULL) ORDER BY repo, i) GROUP BY repo")
def namespaces_deep(spark, d):
    return stores.namespaces(_records(spark, d), 2).select(F.array_join("namespace", "/").alias("namespace"))


@query("SELECT doc_id FROM documents WHERE repo IS NOT NULL AND starts_with(repo, 'lanternworks/') AND ends_with(repo, '/orbweaver')")
def records_in_namespace(spark, d):
    ns = retrieval.namespace_matches(F.col("namespace"), prefix=["lanternworks"], suffix=["orbweaver"])
    return _records(spark, d).where(ns).select("doc_id")


@query(
    """SELECT doc_id, sha256(coalesce(text, '')) AS value FROM documents WHERE repo IS NOT NULL AND NOT starts_with(repo || '/', 'lanternworks/') AND NOT starts_with(repo || '/', 'brasskettle/')
    UNION ALL SELECT doc_id, 'fresh' FROM documents WHERE starts_with(repo || '/', 'lanternworks/') AND lang = 'en' UNION ALL SELECT doc_id, 'new' FROM documents WHERE starts_with(repo || '/', 'brasskettle/') AND lang = 'de'"""
)
def refreshed_records(spark, d):
    """Two namespaces replaced in one go: what is under them gives way to their fresh rows."""
    r = _records(spark, d).select("namespace", "key", "value")
    under = lambda p, lang, v: _records(spark, d).where((F.col("namespace")[0] == p) & (F.col("lang") == lang)).select("namespace", "key", F.lit(v).alias("value"))
    out = stores.refreshed(r, {("lanternworks",): under("lanternworks", "en", "fresh"), ("brasskettle",): under("brasskettle", "de", "new")})
    return out.select(F.col("key").cast("bigint").alias("doc_id"), "value")


@query(
    """WITH r AS (SELECT DISTINCT ON (graph_revision, position) * FROM codegraph_records)
    SELECT repo, graph_revision, count(*) AS records, count(DISTINCT kind) AS kinds, max(position) - min(position) + 1 = count(*) AS complete,
    sum(('0x' || left(sha256(concat_ws(chr(31), kind, identity, coalesce(payload, ''))), 15))::UBIGINT)::HUGEINT::VARCHAR AS fingerprint, graph_revision = max(graph_revision) OVER (PARTITION BY repo) AS latest FROM r GROUP BY repo, graph_revision"""
)
def graph_revisions(spark, d):
    return stores.manifests(table(spark, d, "codegraph_records"))


@query(
    "WITH m AS (" + ORACLE["graph_revisions"] + "), p AS (SELECT *, lag(fingerprint) OVER (PARTITION BY repo ORDER BY graph_revision) AS was FROM m) "
    "SELECT repo, CASE WHEN was = fingerprint AND repo NOT IN (SELECT repo FROM codegraph_records JOIN (SELECT repo, max(graph_revision) AS graph_revision FROM codegraph_records GROUP BY repo) USING (repo, graph_revision) WHERE kind = 'failed') THEN 'reuse' ELSE 'build' END AS action FROM p WHERE latest"
)
def rebuild_plan(spark, d):
    """Whether each repository's graph can be reused: the revision before the latest has the same contents, and no file failed."""
    log = table(spark, d, "codegraph_records")
    m = stores.manifests(log)
    was = m.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("graph_revision")))).where("n = 2").select("repo", "fingerprint")  # few revisions to a repository
    failed = graph.latest_revision(log).where("kind = 'failed'")
    return stores.rebuild_plan(was, m.where("latest"), failed)


@query("SELECT doc_id, row_number() OVER (ORDER BY encode(coalesce(repo, '')), doc_id) - 1 AS place, (row_number() OVER (ORDER BY encode(coalesce(repo, '')), doc_id) - 1) // 100 AS page FROM documents")
def record_pages(spark, d):
    """Every page of an ordered listing, without sorting it in one task."""
    docs = table(spark, d, "documents").select(F.coalesce("repo", F.lit("")).alias("repo"), "doc_id")
    return stores.in_pages(spark, docs, ["repo", "doc_id"], 100).select("doc_id", "place", "page")


@query("SELECT doc_id, sha256('{\"doc_id\":\"' || doc_id || '\",\"lang\":' || coalesce('\"' || lang || '\"', 'null') || ',\"source\":' || coalesce('\"' || source || '\"', 'null') || '}') AS checkpoint FROM documents")
def checkpoint_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", stores.checkpoint_key("doc_id", "lang", "source").alias("checkpoint"))


@query(
    """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'modified' WHEN doc_id % 5 = 0 THEN 'removed' END AS status FROM documents),
    o AS (SELECT doc_id, 'old' AS version FROM documents WHERE doc_id % 3 <> 0)
    SELECT doc_id, version FROM o WHERE doc_id NOT IN (SELECT doc_id FROM c WHERE status IN ('modified', 'removed')) UNION ALL SELECT doc_id, 'new' FROM c WHERE status IN ('added', 'modified')"""
)
def updated_index(spark, d):
    """An index after a diff: what was removed or modified goes, what was added or modified comes. The remainders make up the sides of the diff."""
    docs = table(spark, d, "documents").select("doc_id")
    status = F.when(F.col("doc_id") % 3 == 0, "added").when(F.col("doc_id") % 7 == 0, "modified").when(F.col("doc_id") % 5 == 0, "removed")
    old = docs.where("doc_id % 3 <> 0").withColumn("version", F.lit("old"))
    return retrieval.update_index(old, docs.withColumn("version", F.lit("new")), docs.withColumn("status", status))


# Sinks


@query(f"SELECT 'csv' AS format, count(*) AS rows FROM {NORM} UNION ALL SELECT 'json', count(*) FROM {NORM} UNION ALL SELECT 'sarif', count(*) FROM {NORM} UNION ALL SELECT 'html', count(*) FROM {NORM}")
def report_formats(spark, d):
    """The findings written in every format, and the rows that are read back from each."""
    f, base = findings(spark, d), f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    for kind in ("csv", "json", "sarif", "html"):
        files.write_findings(f, f"{base}/report.{kind}")
    csv = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{base}/report.csv")
    sarif = spark.read.text(f"{base}/report.sarif").select(F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$.runs[0].results", "array<variant>")).alias("at", "r"))
    n = lambda kind, df: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(kind).alias("format"), "rows")
    got = n("csv", csv).unionByName(n("json", spark.read.json(f"{base}/report.json"))).unionByName(n("sarif", sarif))
    return got.unionByName(n("html", spark.read.json(f"{base}/report.html/data/findings")))


@query("SELECT record_id, row_number() OVER (ORDER BY part, record_id) - 1 AS seq FROM (SELECT DISTINCT record_id, record <> 'event' AS part FROM runlog WHERE record_id IS NOT NULL)")
def appended_trace(spark, d):
    """Trace records appended in two writes, numbered on without a gap."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/trace"
    log = source_text.once(table(spark, d, "runlog").where("record_id is not null").select("record_id", "record", "run_id", "span_id"), "record_id")
    files.append_trace(spark, log.where("record = 'event'"), ["record_id"], path)
    files.append_trace(spark, log.where("record <> 'event'"), ["record_id"], path)
    return spark.read.json(path).select("record_id", "seq")


# Paths

_FAILED = "(SELECT DISTINCT run_id AS repo, span_id AS id FROM runlog WHERE status = 'error' AND record = 'span.end')"
_UP = f"""e AS MATERIALIZED (SELECT * FROM {_SPANS}), roots AS MATERIALIZED (SELECT DISTINCT repo, src AS id FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.repo = e.repo AND x.dst = e.src)),
    w AS (SELECT repo, id AS target, id AS node, [id] AS path FROM {_FAILED} UNION ALL SELECT w.repo, w.target, e.src, list_append(w.path, e.src) FROM w JOIN e ON e.repo = w.repo AND e.dst = w.node WHERE len(w.path) < 25 AND NOT list_contains(w.path, e.src)),
    b AS (SELECT w.repo, target, arg_min(path, struct_pack(n := len(path), p := path)) AS path FROM w JOIN roots r ON r.repo = w.repo AND r.id = w.node GROUP BY w.repo, target)"""


def _error_paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = _span_edges(spark, d)
    roots = e.select("repo", F.col("src").alias("id")).distinct().join(e.select("repo", F.col("dst").alias("id")), ["repo", "id"], "left_anti")
    failed = table(spark, d, "runlog").where("record = 'span.end' and status = 'error'").select(F.col("run_id").alias("repo"), F.col("span_id").alias("id")).distinct()
    return e, failed, graph.source_paths(spark, e, roots, failed)


@query(f"WITH RECURSIVE {_UP} SELECT repo, target, path[-1] AS source, array_to_string(list_reverse(path), '>') AS path, len(path) - 1 AS hops FROM b")
def error_paths(spark, d):
    """The shortest path from a root of its trace to each failed span: whole paths."""
    return _error_paths(spark, d)[2].withColumn("path", F.array_join("path", ">"))


_FOCUS = f"f AS MATERIALIZED (SELECT repo, id FROM {_FAILED} UNION SELECT repo, unnest(path) FROM b UNION SELECT e.repo, e.dst FROM e JOIN {_FAILED} t ON t.repo = e.repo AND t.id = e.src UNION SELECT e.repo, e.src FROM e JOIN {_FAILED} t ON t.repo = e.repo AND t.id = e.dst)"


@query(f"WITH RECURSIVE {_UP}, {_FOCUS} SELECT repo, id FROM f")
def focus_spans(spark, d):
    """What one looks at to understand the failures: the failed spans, their paths, and what is next to them."""
    e, failed, paths = _error_paths(spark, d)
    return graph.focus(e, failed, paths)


@query(f"WITH RECURSIVE {_UP}, {_FOCUS} SELECT e.repo, e.src, e.dst FROM e JOIN f a ON a.repo = e.repo AND a.id = e.src JOIN f b2 ON b2.repo = e.repo AND b2.id = e.dst")
def focus_edges(spark, d):
    """The links among these spans."""
    e, failed, paths = _error_paths(spark, d)
    keep = graph.focus(e, failed, paths)
    return graph.induced(keep, e, keep)[1].select("repo", "src", "dst")


@query(
    f"""WITH RECURSIVE {_UP}, s AS (SELECT b.repo, target, array_to_string(list_reverse(path), '>') AS path, len(path) - 1 AS hops, (SELECT count(*) FROM {_FAILED} t WHERE t.repo = b.repo AND list_contains(b.path, t.id)) AS sinks FROM b)
    SELECT repo, target, sinks, row_number() OVER (PARTITION BY repo ORDER BY sinks DESC, hops, target, path) AS rank FROM s"""
)
def ranked_error_paths(spark, d):
    """The error paths of each run, those with the most failures first, then the shorter."""
    _, failed, paths = _error_paths(spark, d)
    on = paths.select("repo", "target", F.explode("path").alias("id")).join(failed, ["repo", "id"]).groupBy("repo", "target").agg(F.count(F.lit(1)).alias("sinks"))
    full = paths.join(on, ["repo", "target"]).select("repo", "target", F.array_join("path", ">").alias("path"), "hops", "sinks", F.lit("").alias("file"), F.lit(0).alias("line"), F.col("target").alias("name"))
    return graph.ranked_paths(full, ["repo"]).select("repo", "target", "sinks", "rank")


# C and C++


@query()
def c_functions(spark, d):
    f = _c_files(spark, d)
    return c_facts.functions_of(c_facts.extract(f), f)


@query()
def c_known_at_calls(spark, d):
    """What is known to be null or not at each call, from the conditions around and before it."""
    return c_facts.extract(_c_files(spark, d)).where("kind in ('null', 'nonnull', 'condition')").select("request_id", "function", "kind", "symbol", "line", "start_byte", "detail")
