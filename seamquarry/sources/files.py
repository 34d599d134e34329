"""Reading repositories, notebooks, patches and reports; writing findings."""

from __future__ import annotations

import html
import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def source_files(spark: SparkSession, root: str, ignore: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path, rel_path, content of the files below a folder that the rules let through, in the order: ignore rules, include globs if any, exclude globs.

    The filters are on the path, so Spark applies them to the listing before any content is decoded. Undecodable bytes become U+FFFD.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.removeprefix("file:").rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{T.glob_regex(base)[1:-1]}", "")
    keep = ~T.ignored(rel, ignore or [])
    for globs, want in ((include, True), (exclude, False)):
        if globs:
            hit = F.lit(False)
            for g in globs:
                hit = hit | rel.rlike(T.glob_regex(g))
            keep = keep & (hit if want else ~hit)
    return files.where(keep).select("path", rel.alias("rel_path"), F.decode("content", "UTF-8").alias("content"))


def notebook_code(df: DataFrame, text: str) -> DataFrame:
    """df with `code`: the non-blank code cells of a notebook, each under its number; a text that isn't a notebook passes through."""
    cells = F.try_variant_get(F.try_parse_json(text), "$.cells", "array<variant>")
    kept = F.filter(cells, lambda c: F.try_variant_get(c, "$.cell_type", "string") == "code")
    src = F.transform(kept, lambda c: F.coalesce(F.array_join(F.try_variant_get(c, "$.source", "array<string>"), ""), F.try_variant_get(c, "$.source", "string"), F.lit("")))
    full = F.filter(src, lambda s: F.trim(F.translate(s, "\n\r\t", "   ")) != "")
    return df.withColumn("code", F.when(cells.isNull(), F.col(text)).otherwise(F.array_join(F.transform(full, lambda s, i: F.concat(F.lit("# Cell "), (i + 1).cast("string"), F.lit("\n"), s)), "\n\n")))


def write_csv(findings: DataFrame, path: str) -> None:
    """The eight columns of the findings report. Null cells are empty."""
    cols = {"File": "file", "Line": "line", "Severity": "severity", "CWE": "cwe", "Issue": "issue", "Reasoning": "reasoning", "Mitigation": "mitigation", "Confidence": "confidence"}
    findings.select(*(F.col(c).alias(n) for n, c in cols.items())).write.mode("overwrite").option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_sarif(results: DataFrame, path: str, tool: str) -> None:
    """SARIF 2.1.0, one log for each partition file: a row of `results` (result, JSON) is one result. Written by the executors, nothing is gathered."""

    def logs(batches):
        import pandas as pd

        rows = [r for b in batches for r in b["result"]]
        if rows:
            head = json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"})[:-1]
            yield pd.DataFrame({"value": [f'{head}, "runs": [{{"tool": {{"driver": {json.dumps({"name": tool, "rules": [{"id": "AI001"}]})}}}, "results": [{", ".join(rows)}]}}]}}']})

    results.select("result").mapInPandas(logs, "value string").write.mode("overwrite").text(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """Chunks or vectors partitioned by collection; only the collections that come are replaced."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def write_html(spark: SparkSession, title: str, rollups: dict[str, DataFrame], path: str) -> None:
    """A folder with a page and, beside it, all rows of each roll-up as JSON lines, written by the executors; the page names their files."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    links = []
    for name, df in rollups.items():
        df.write.mode("overwrite").json(f"{path}/data/{name}")
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/data/{name}")
        links += [f"data/{name}/{f.getPath().getName()}" for f in place.getFileSystem(conf).listStatus(place) if f.getPath().getName().startswith("part-")]
    rows = "".join(f'<li><a href="{html.escape(x)}">{html.escape(x)}</a></li>' for x in sorted(links))
    script = "for (const a of document.querySelectorAll('a')) fetch(a.href).then(r => r.text()).then(t => { const p = document.createElement('pre'); p.textContent = t; a.after(p); });"
    page = jvm.org.apache.hadoop.fs.Path(f"{path}/index.html")
    out = page.getFileSystem(conf).create(page, True)
    out.write(bytearray(f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ul>{rows}</ul><script>{script}</script>'.encode()))
    out.close()


# Endings of documentation.
DOC_ENDINGS = [".md", ".markdown", ".rst", ".txt", ".adoc"]


def suffix_matches(name, pattern: str):
    """A name against a suffix pattern, whatever the case: without * it ends so, with one * at the end it holds what is before it, else it is a shell pattern."""
    name, p = F.lower(name), pattern.lower()
    if "*" not in p:
        return name.endswith(p)
    if p.count("*") == 1 and p.endswith("*"):
        return name.contains(p[:-1])
    return name.rlike("^" + re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") + "$")


def language_of(path, rules: list[tuple[str, list[str], list[str], int]]):
    """A column with the language of a path: rules are (language, endings, file name patterns, priority).

    Endings decide before patterns and the greatest priority before others; two languages of one priority for an ending are an error.
    """
    seen: dict[tuple[str, int], str] = {}
    for lang, endings, _, rank in rules:
        for x in endings:
            if seen.setdefault((x.lower(), rank), lang) != lang:
                raise ValueError(f"{x} belongs to {seen[x.lower(), rank]} and {lang}")
    ending = F.lower(F.regexp_extract(path, r"\.[^.\\/]*$", 0))
    name = F.regexp_extract(path, r"[^\\/]*$", 0)
    out = F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (r[3], r[0]))
    for lang, _, patterns, _ in ordered:
        for x in patterns:
            out = F.when(suffix_matches(name, x), lang).otherwise(out)
    for lang, endings, _, _ in ordered:
        out = F.when(ending.isin([x.lower() for x in endings]), lang).otherwise(out) if endings else out
    return out


def index_inputs(files: DataFrame, path: str, languages: DataFrame) -> DataFrame:
    """files with `part`, docs or code: documentation by its ending, which comes before the language, and files of a known language; others are left out."""
    known = languages.select(F.explode("extensions").alias("x")).select(F.lower("x").alias("ending")).where("ending is not null").distinct().withColumn("known", F.lit(True))
    met = files.withColumn("ending", F.lower(F.regexp_extract(path, r"\.[^.\\/]*$", 0))).join(known, "ending", "left")
    return met.withColumn("part", F.when(F.col("ending").isin(DOC_ENDINGS), "docs").when(F.col("known"), "code")).where("part is not null").drop("ending", "known")


def under_parent(root: str, rel_path):
    """A path with the name of the folder above it first, as an index names its documents."""
    return F.concat(F.lit(root.rstrip("/").rpartition("/")[2] + "/"), rel_path)


def scanned(paths: DataFrame, path: str, patterns: list[str], endings: list[str]) -> DataFrame:
    """Rows whose path, repository-relative, matches one of the globs and has one of the endings; paths with .. never do."""
    rel = T.repo_path(F.col(path))
    hit = F.lit(False)
    for g in patterns:
        hit = hit | rel.rlike("(?i)" + T.glob_regex(g))
    return paths.where(hit & F.lower(rel).rlike("(?:" + "|".join(map(re.escape, endings)) + ")$") & ~rel.rlike(r"(?:^|/)\.\.(?:/|$)"))


def findings_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, position, review (variant): the items of the `reviews` list of JSON objects; another shape has no rows."""
    items = F.try_variant_get(F.try_parse_json(text), "$.reviews", "array<variant>")
    return df.select(key, F.posexplode(items).alias("position", "review"))


def has_columns(spark: SparkSession, name: str, wanted: list[str]) -> bool:
    """Whether a table or view exists and has the columns: a look at the catalog, not at the data."""
    return spark.catalog.tableExists(name) and set(wanted) <= set(spark.table(name).columns)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines. The files appear under their names when the whole write is done, so a reader sees all of it or nothing."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_findings(findings: DataFrame, path: str, annotations: DataFrame | None = None) -> str:
    """Findings in the format that the path's ending names (.html, .csv, .sarif, else JSON), with annotations by finding_id first; gives the format."""
    full = findings if annotations is None else findings.join(annotations, "finding_id", "left")
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "json"
    if kind == "csv":
        write_csv(full, path)
    elif kind == "html":
        from ..operators.reports import file_stats, folder_stats, severity_counts

        write_html(full.sparkSession, "Findings", {"severity": severity_counts(full), "files": file_stats(full), "folders": folder_stats(full), "findings": full}, path)
    elif kind == "sarif":
        from ..operators.reports import sarif_results

        n = full.groupBy("file").agg(F.max(F.greatest(F.coalesce("line", F.lit(1)), F.coalesce("end_line", F.lit(1)))).alias("n_lines"))
        write_sarif(sarif_results(full, n), path, "findings")
    else:
        kind = "json"
        write_json(full, path)
    return kind


def planned_outputs(wanted: dict[str, list[str]], formats: list[str]) -> dict[str, list[str]]:
    """Output paths of each stage, unique and disjoint between stages, with the formats that a stage lacks added beside its first path."""
    out, taken = {}, set()
    for stage, paths in wanted.items():
        paths = list(dict.fromkeys(paths))
        if taken & set(paths):
            raise ValueError(f"two stages write {sorted(taken & set(paths))}")
        base = paths[0].rsplit(".", 1)[0] if paths else stage
        have = {x.rsplit(".", 1)[-1] for x in paths}
        out[stage] = [*paths, *(f"{base}.{f}" for f in formats if f not in have and f"{base}.{f}" not in taken)]
        taken |= set(out[stage])
    return out


def append_trace(spark: SparkSession, records: DataFrame, order: list[str], path: str) -> None:
    """Records to a folder of JSON lines, `seq` going on without a gap from what is there. One writer at a time."""
    from ..operators.stores import in_pages

    try:
        last = spark.read.schema("seq bigint").json(path).agg(F.max("seq")).first()[0]
    except AnalysisException:
        last = None
    numbered = in_pages(spark, records.drop("seq"), order, 1).withColumn("seq", F.col("place") + (0 if last is None else last + 1)).drop("place", "page")
    numbered.write.mode("append").json(path)


def usage_summary(totals: DataFrame) -> DataFrame:
    """scope, summary: one JSON object for each scope with its totals by model and operation (of `usage_totals`); few rows make one cell."""
    parts = totals.where("grouping in (1, 2) and scope is not null").groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("grouping", "model", "operation", "input_tokens", "output_tokens", "total_tokens"))).alias("parts"))
    own = totals.where("grouping = 3").select("scope", "input_tokens", "output_tokens", "total_tokens")
    return own.join(parts, "scope", "left").select("scope", F.to_json(F.struct("input_tokens", "output_tokens", "total_tokens", "parts")).alias("summary"))
