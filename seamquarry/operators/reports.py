"""Findings: normal forms, roll-ups, merging, annotation, SARIF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph

FIELDS = ["issue", "code_snippet", "reasoning", "mitigation", "cwe", "severity"]


def normalised(findings: DataFrame) -> DataFrame:
    """Review rows as a report shows them: null strings empty, strings stripped, unknown CWE named so, severity in title case, confidence 0 where null or not a number."""
    out = findings
    for c in FIELDS:
        out = out.withColumn(c, T.stripped(F.col(c)))
    conf = F.coalesce(F.col("confidence"), F.lit(0.0))
    return (
        out.withColumn("cwe", F.when(F.col("cwe") == "", "CWE-Unknown").otherwise(F.col("cwe")))
        .withColumn("severity", T.severity_title(F.col("severity")))
        .withColumn("confidence", F.when(F.isnan(conf), 0.0).otherwise(conf))
    )


def severity_counts(f: DataFrame) -> DataFrame:
    """severity, n and cwe, n in one table: dimension, value, n. One pass over the findings by grouping sets."""
    pairs = F.explode(F.array(F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("value")), F.struct(F.lit("cwe").alias("dimension"), F.col("cwe").alias("value"))))
    return f.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def file_stats(f: DataFrame) -> DataFrame:
    """file, n, critical, high, medium, low, max_severity: for each file; unknown spellings rank lowest."""
    rank = T.severity_rank(F.col("severity"))
    top = F.max(F.when(rank > 0, F.struct(rank.alias("r"), F.col("severity").alias("s"))))
    per = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("Critical", "High", "Medium", "Low")]
    return f.groupBy(F.coalesce("file", F.lit("Unknown")).alias("file")).agg(F.count(F.lit(1)).alias("n"), *per, F.coalesce(top["s"], F.lit("Unknown")).alias("max_severity"))


def folder_stats(f: DataFrame) -> DataFrame:
    """folder, severity, n by top folder."""
    return f.groupBy(T.top_folder(F.col("file")).alias("folder"), "severity").agg(F.count(F.lit(1)).alias("n"))


def grouped(f: DataFrame) -> DataFrame:
    """file, reviews: each file's findings by severity, line, text and id, as structs. A file's findings make one row, as the report wants it."""
    item = F.struct((-T.severity_rank(F.col("severity"))).alias("order"), F.coalesce("line", F.lit(0)).alias("line"), "issue", "finding_id", "severity", "cwe")
    return f.groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("reviews"))


def unique_findings(f: DataFrame, content: list[str], key: str) -> DataFrame:
    """The least key of each distinct content, and how many had it: key, copies. Nulls equal nulls."""
    return f.groupBy(*content).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies")).select(key, "copies")


def merge_groups(spark: SparkSession, ids: DataFrame, decisions: DataFrame) -> DataFrame:
    """id, representative: findings joined into sets by duplicate decisions (decision_no, members array, representative).

    Members outside `ids` and repeats are dropped first; a decision with fewer than two members says nothing. In each set the latest
    decision with a valid representative names it, else the least id does. Sets are connected components.
    """
    known = ids.select(F.col("id").alias("member")).distinct()
    m = decisions.select("decision_no", "representative", F.explode(F.array_distinct("members")).alias("member")).join(known, "member", "left_semi")
    per = m.groupBy("decision_no").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("first"), F.max(F.when(F.col("member") == F.col("representative"), F.col("member"))).alias("named")).where("n > 1")
    pairs = m.join(per, "decision_no").select(F.col("member").alias("a"), F.col("first").alias("b"))
    sets = graph.components(spark, ids, pairs)
    wish = per.where("named is not null").join(sets, F.col("named") == F.col("id")).groupBy("component").agg(F.max_by("named", "decision_no").alias("chosen"))
    return sets.join(wish, "component", "left").select("id", F.coalesce("chosen", "component").alias("representative"))


def annotate(f: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """f with the columns of notes, by key; a key that is on either side more than once, null or blank, gets none."""
    single = lambda d: d.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(key)
    good = notes.join(single(notes), key, "left_semi").join(single(f), key, "left_semi")
    return f.join(good, key, "left")


def sarif_findings(reports: DataFrame, triaged: str = "triaged", include_triaged: bool = False) -> DataFrame:
    """report_id, run_index, result_index, rule_id, message, file_path, line, snippet, source_tool: one row for each result object.

    The first location counts; lines that aren't positive numbers are 1; the message may be an object or a string; a result whose
    properties say `triaged` is left out unless asked for. Payloads encoded twice are decoded; broken ones give nothing. JVM only.
    """
    raw = F.regexp_replace("payload", "^\\ufeff", "")
    v = F.try_parse_json(raw)
    twice = F.try_parse_json(F.regexp_replace(F.try_variant_get(v, "$", "string"), "^\\ufeff", ""))
    v = F.when(raw.startswith('"'), twice).otherwise(v)
    base = reports.select("report_id", v.alias("v")).where("v is not null")
    runs = base.select("report_id", F.posexplode(F.try_variant_get("v", "$.runs", "array<variant>")).alias("run_index", "run"))
    name, full = (F.trim(F.coalesce(F.try_variant_get("run", f"$.tool.driver.{k}", "string"), F.lit(""))) for k in ("name", "fullName"))
    res = runs.select("report_id", "run_index", F.when(name != "", name).otherwise(full).alias("source_tool"), F.posexplode(F.try_variant_get("run", "$.results", "array<variant>")).alias("result_index", "r"))
    res = res.where(F.schema_of_variant("r").startswith("OBJECT"))
    get = lambda path, t="string": F.try_variant_get("r", path, t)
    line = get("$.locations[0].physicalLocation.region.startLine", "int")
    loc = "$.locations[0].physicalLocation"
    text = F.coalesce(F.when(F.schema_of_variant(get("$.message", "variant")).startswith("OBJECT"), get("$.message.text")).otherwise(get("$.message")), F.lit(""))
    out = res if include_triaged else res.where(~F.coalesce(F.try_variant_get("r", f"$.properties.{triaged}", "boolean"), F.lit(False)))
    return out.select(
        "report_id", "run_index", "result_index", F.coalesce(get("$.ruleId"), F.lit("")).alias("rule_id"), text.alias("message"),
        F.coalesce(get(f"{loc}.artifactLocation.uri"), F.lit("")).alias("file_path"), F.when(line > 0, line).otherwise(1).alias("line"),
        F.coalesce(get(f"{loc}.region.snippet.text"), F.lit("")).alias("snippet"), "source_tool",
    )


LEVELS = {"Critical": "error", "High": "error", "Medium": "warning", "Low": "note"}


def sarif_results(f: DataFrame, file_lines: DataFrame, rule: str = "AI001") -> DataFrame:
    """finding_id, file, result: each finding as a SARIF result in JSON. Lines are kept within the file's (file, n_lines); the reported one stays in the properties when it was outside."""
    met = f.join(file_lines, "file", "left").withColumn("asked", F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)))
    met = met.withColumn("at", F.least("asked", F.greatest(F.coalesce("n_lines", F.col("asked")), F.lit(1))))
    level = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), F.col("severity")), F.lit("warning"))
    end = F.greatest("at", F.coalesce("end_line", "at"))
    region = F.struct(F.col("at").alias("startLine"), F.least(end, F.greatest(F.coalesce("n_lines", end), F.col("at"))).alias("endLine"), F.struct(F.coalesce("code_snippet", F.lit("")).alias("text")).alias("snippet"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    props = F.struct("severity", "cwe", "confidence", F.when(F.col("asked") != F.col("at"), F.col("asked")).alias("reportedLineNumber"))
    result = F.struct(F.lit(rule).alias("ruleId"), level.alias("level"), F.struct(F.col("issue").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(T.location_fingerprint(F.col("file"), F.col("at"), F.lit(rule)).alias("primaryLocationLineHash")).alias("partialFingerprints"), props.alias("properties"))
    return met.select("finding_id", "file", level.alias("level"), F.col("at").alias("line"), F.to_json(result).alias("result"))


def usage_totals(events: DataFrame) -> DataFrame:
    """scope, model, operation, input_tokens, output_tokens, total_tokens, grouping: totals overall and by scope, each also by model and by operation.

    Negative counts are 0, a missing total is input plus output, an unknown model is `unknown`, an unknown operation `llm`. Rows
    without a scope count only in the sets without scope. One grouping-sets pass: every row is aggregated before the shuffle.
    """
    zero = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("bigint")
    e = events.select(
        F.when(F.col("scope_id") != "", F.col("scope_id")).alias("scope"), F.coalesce("model", F.lit("unknown")).alias("model"), F.coalesce("operation", F.lit("llm")).alias("operation"),
        zero("input_tokens").alias("i"), zero("output_tokens").alias("o"),
        F.greatest(F.coalesce(F.col("total_tokens"), F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))), F.lit(0)).cast("bigint").alias("t"),
    )
    s, m, o = F.col("scope"), F.col("model"), F.col("operation")
    g = e.groupingSets([[s], [s, m], [s, o], [m], [o], []], s, m, o).agg(F.grouping_id().alias("grouping"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum("t").alias("total_tokens"))
    return g.where((F.col("grouping") >= 4) | F.col("scope").isNotNull())


def operation_report(totals: DataFrame) -> DataFrame:
    """operation, total_tokens with tokens, the most first, then by name, numbered by rank: one row for each operation name."""
    t = totals.where("grouping = 6 and total_tokens > 0").select("operation", "total_tokens")
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total_tokens"), "operation")))


def report_rows(f: DataFrame) -> DataFrame:
    """finding_id and the columns of the findings report, without nulls."""
    return f.select("finding_id", F.coalesce("file", F.lit("")).alias("File"), F.coalesce("line", F.lit(0)).alias("Line"), *(F.col(c.lower()).alias(c) for c in ("Severity", "CWE", "Issue", "Reasoning", "Mitigation")))


def rebuilt(f: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """The findings of the keep-set, as they were; groups that lose all of theirs are gone with them."""
    return f.join(keep.select(key).distinct(), key, "left_semi")


def applying(path: Column, scopes: list[str]) -> Column:
    """The scopes that apply to a path: `repository` and empty ones to all, those with * ? or [ as globs, others to that path and what is below it."""
    tests = []
    for s in scopes:
        bare = s.rstrip("/")
        if s in ("", "repository"):
            hit = F.lit(True)
        elif any(c in s for c in "*?["):
            hit = path.rlike(T.glob_regex(s))
        else:
            hit = (path == bare) | path.startswith(bare + "/")
        tests.append(F.when(hit, F.lit(s)))
    return F.array_compact(F.array(*tests))


def folded_status(df: DataFrame, group: str, status: str) -> DataFrame:
    """group, ended, status: ok if all are, inconclusive if some are, else failed."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("ended"), F.count_if(F.col(status) == "ok").alias("ok"))
    return g.select(group, "ended", F.when(F.col("ok") == F.col("ended"), "ok").when(F.col("ok") > 0, "inconclusive").otherwise("failed").alias("status"))
