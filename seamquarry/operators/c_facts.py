"""Facts from C and C++ text: functions, calls, parameters, locks, loops, returns, assignments. Syntax only, one file at a time.

Comments and literals are blanked first, keeping every position, so patterns cannot match inside them. Preprocessor lines
are blanked too. A definition is a name, a parameter list and a body at file, namespace or class level.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import Scratch
from . import c_flow

FACTS = "request_id bigint, function string, kind string, symbol string, line int, start_byte int, arguments int, detail string, scope_start int, scope_end int"
# Words that stand before a parenthesis without being called, and the lock functions.
NOT_CALLED = set("if for while switch return sizeof catch alignof decltype defined typeof __attribute__ noexcept static_assert _Static_assert alignas".split())
LOCKS = set("pthread_mutex_lock mutex_lock spin_lock spin_lock_irqsave spin_lock_irq".split())
UNLOCKS = set("pthread_mutex_unlock mutex_unlock spin_unlock spin_unlock_irqrestore spin_unlock_irq".split())
_HIDE = re.compile(r'//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)|R"\((?:.*?)\)"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_DIRECTIVE = re.compile(r"^[ \t]*#(?:\\\n|[^\n])*", re.M)
_HEAD = re.compile(r"((?:[A-Za-z_]\w*::)*~?[A-Za-z_]\w*|operator\s*[^\s\w(]{1,3})\s*\(")
_CALL = re.compile(r"(?:(\.|->)\s*)?((?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)\s*\(")
_ASSIGN = re.compile(r"([A-Za-z_]\w*(?:\s*(?:->|\.)\s*\w+|\s*\[[^\]]*\])*)\s*(?:[-+*/%&|^]|<<|>>)?=(?!=)")
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def _blank(m: re.Match) -> str:
    return "".join("\n" if c == "\n" else " " for c in m.group())


def masked(text: str) -> str:
    """The text with comments, literals and directives blanked, as long as before."""
    return _DIRECTIVE.sub(_blank, _HIDE.sub(lambda m: _blank(m) if m.group()[0] == "/" else m.group()[0] + "".join("\n" if c == "\n" else "_" for c in m.group()[1:-1]) + m.group()[-1], text))


def closing(text: str, at: int) -> int:
    """The place of the bracket that closes the one at `at`, or -1."""
    depth: list[str] = []
    for m in re.compile(r"[()\[\]{}]").finditer(text, at):
        c = m.group()
        if c in _PAIRS:
            depth.append(_PAIRS[c])
        elif not depth or depth.pop() != c:
            return -1
        elif not depth:
            return m.start()
    return -1


def arguments(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The spans of the arguments between two brackets, cut at commas that no bracket encloses; blank ones are none."""
    out, start, depth = [], a, 0
    for i in range(a, b):
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            out.append((start, i))
            start = i + 1
    out.append((start, b))
    return out if text[a:b].strip() else []


def lock_name(expression: Column) -> Column:
    """A lock expression without white space, casts before it, parentheses around it and address-of; `->` as a dot, of `a.b.lock` the last two parts."""
    v = F.replace(F.regexp_replace(expression, T.SPACE, ""), F.lit("->"), F.lit("."))
    for pattern, put in (
        (r"^(?:\([^)]*\)&*)+(?=[^&])", ""),  # brackets before something else: casts
        (r"^\(([^)]*)\)&*$", "$1"),
        (r"^[&()]+|[&()]+$", ""),
        (r"^.*\.([^.]*\.lock)$", "$1"),
    ):
        v = F.regexp_replace(v, pattern, put)
    return v


@dataclass
class Definition:
    """A function definition in a masked text, by places in it."""

    name: str
    start: int
    opening: int
    closing: int
    body: int
    end: int
    line: int
    last_line: int
    before: str


_TAIL = re.compile(r"\s*(?:const\b|noexcept\b|override\b|final\b|volatile\b|&&?|->\s*[\w:<>,*&\s]+?)*\s*(?::[^;{}]*(?:\{[^{}]*\}[^;{}]*)*)?\{")
_NO_HEAD = re.compile(r"=|\b(?:return|else|do|case|goto|new|throw)\b")


def definitions(m: str) -> Iterator[Definition]:
    """The function definitions of a masked text, in order; one that breaks off ends with the text."""
    starts = [0, *(x.end() for x in re.finditer("\n", m))]
    at = 0
    while h := _HEAD.search(m, at):
        at = h.end()
        if h[1] in NOT_CALLED or (end := closing(m, h.end() - 1)) < 0:
            continue
        tail = _TAIL.match(m, end + 1)
        before = m[max(m.rfind(c, 0, h.start()) for c in ";{}") + 1 : h.start()]
        if not tail or _NO_HEAD.search(before):
            continue
        stop = closing(m, tail.end() - 1)
        stop = len(m) if stop < 0 else stop
        yield Definition(h[1], h.start(), h.end(), end, tail.end(), stop, bisect_right(starts, h.start()), bisect_right(starts, min(stop, len(m) - 1)), before)
        at = stop


_PROTOTYPE = re.compile(r"((?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)\s*\(")
_FILE_VALUE = re.compile(r"(?:^|(?<=[;}]))\s*(?:[A-Za-z_][\w:<>]*[\s*&]+)+([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)*(=|;)", re.M)
_NO_RETURN = re.compile(r"\b(?:_Noreturn|noreturn|__noreturn__|__noreturn)\b")


def _outside(m: str, found: list[Definition]) -> str:
    """The masked text with the bodies of its functions blanked too, and the insides of its other braces kept."""
    out, at = [], 0
    for d in found:
        out += [m[at : d.body], re.sub(r"[^\n]", " ", m[d.body : d.end])]
        at = d.end
    return "".join([*out, m[at:]])


def facts(text: str) -> Iterator[tuple]:
    """(function, kind, symbol, line, start byte, arguments, detail, scope start, scope end).

    Of functions: function, parameter, call, lock, unlock, loop, return, assignment, value, reference (a function's name put into a
    variable), condition and null or nonnull (what is known at a call, which the start byte names), noreturn. Of the file:
    declaration, global (a value at file level), initialiser (a function's name in a global's initial value).
    """
    text = text.replace("\r\n", "\n")
    m = masked(text)
    starts = [0, *(x.end() for x in re.finditer("\n", m))]
    line = lambda p: bisect_right(starts, p)
    byte = (lambda p: p) if text.isascii() else list(accumulate((len(c.encode("utf-8", "replace")) for c in text), initial=0)).__getitem__
    found = list(definitions(m))
    for d in found:
        name, stop = d.name, d.end
        params = arguments(m, d.opening, d.closing)
        static = bool(re.search(r"\bstatic\b", d.before))
        scope = (byte(d.body), byte(stop))
        yield name, "function", name, d.line, byte(d.start), len([p for p in params if m[p[0] : p[1]].strip() != "void"]), "internal" if static else "external", *scope
        if _NO_RETURN.search(d.before):
            yield name, "noreturn", name, d.line, byte(d.start), None, None, None, None
        for a, b in params:
            words = re.findall(r"[A-Za-z_]\w*", m[a:b])
            if len(words) > 1:
                pointer = re.search(r"\(\s*\*+\s*([A-Za-z_]\w*)", m[a:b])
                called = pointer[1] if pointer else words[-1]
                yield name, "parameter", called, line(a), byte(a), None, " ".join(text[a:b].split()), *scope
                yield name, "value", called, line(a), byte(a), None, "function_pointer" if pointer else "value", *scope
        body = (d.body, stop)
        spans = c_flow.blocks(m, *body)
        for called, kind, at, a, z in c_flow.values(m, *body, spans):
            yield name, "value", called, line(at), byte(at), None, kind, byte(a), byte(z)
        for target, called, at in c_flow.stores(m, *body):
            yield name, "reference", called, line(at), byte(at), None, target, *map(byte, c_flow.innermost(spans, at))
        tests = c_flow.branches(m, *body, spans, closing)
        for c in _CALL.finditer(m, *body):
            callee = c[2]
            if callee in NOT_CALLED or re.search(r"\b(?:struct|new)\s+$", m[max(0, c.start() - 8) : c.start()]):
                continue
            close = closing(m, c.end() - 1)
            args = arguments(m, c.end(), close) if close >= 0 else []
            yield name, "call", callee, line(c.start(2)), byte(c.start(2)), len(args), "member" if c[1] else "direct", None, None
            if callee in LOCKS | UNLOCKS and args:
                yield name, "lock" if callee in LOCKS else "unlock", text[args[0][0] : args[0][1]], line(c.start()), byte(c.start()), None, callee, None, None
            conditions, nulls = c_flow.known(m, c.start(), tests)
            for condition, holds, guard in conditions:
                yield name, "condition", condition, line(c.start(2)), byte(c.start(2)), None, ("guard " if guard else "") + ("true" if holds else "false"), None, None
            for path, null in sorted(nulls):
                yield name, "null" if null else "nonnull", path, line(c.start(2)), byte(c.start(2)), None, None, None, None
        for c in re.compile(r"\b(for|while|do)\b").finditer(m, *body):
            yield name, "loop", c[1], line(c.start()), byte(c.start()), None, None, None, None
        for c in re.compile(r"\breturn\b([^;]*);").finditer(m, *body):
            yield name, "return", " ".join(text[c.start(1) : c.end(1)].split()), line(c.start()), byte(c.start()), None, None, None, None
        for c in _ASSIGN.finditer(m, *body):
            yield name, "assignment", re.sub(r"\s+", "", c[1]).replace("->", "."), line(c.start()), byte(c.start()), None, None, None, None
    rest = _outside(m, found)
    defined = {d.start for d in found}
    for h in _PROTOTYPE.finditer(rest):
        end = closing(rest, h.end() - 1)
        before = rest[max(rest.rfind(c, 0, h.start()) for c in ";{}") + 1 : h.start()]
        if h.start() in defined or h[1] in NOT_CALLED or end < 0 or not re.match(r"\s*(?:const\b|noexcept\b|override\b|__attribute__\s*\(\(.*?\)\))*\s*(?:=\s*(?:0|default|delete)\s*)?;", rest[end + 1 :]) or not before.strip() or "=" in before or "(" in before:
            continue
        params = [p for p in arguments(rest, h.end(), end) if rest[p[0] : p[1]].strip() != "void"]
        least = sum("=" not in rest[a:b] and "..." not in rest[a:b] for a, b in params)
        yield None, "declaration", h[1], line(h.start()), byte(h.start()), least, "internal" if re.search(r"\bstatic\b", before) else "external", None, None
    for g in _FILE_VALUE.finditer(rest):
        if g[1] in NOT_CALLED or re.match(r"\s*(?:typedef|using|namespace|return|extern\s+\"|enum\s+\w+\s*;|struct\s+\w+\s*;|class\s+\w+\s*;|union\s+\w+\s*;)", g[0]):
            continue
        yield None, "global", g[1], line(g.start(1)), byte(g.start(1)), None, "value", None, None
        if g[2] == "=":
            end = rest.find(";", g.end())
            for x in re.finditer(r"(?:[=,{(?:&]|^)\s*&?\s*([A-Za-z_]\w*)\s*(?=[,;}:)])", rest[g.end() - 1 : end + 1 if end >= 0 else None]):
                yield None, "initialiser", x[1], line(g.end() - 1 + x.start(1)), byte(g.end() - 1 + x.start(1)), None, g[1], None, None


def extract(files: DataFrame) -> DataFrame:
    """FACTS of files (request_id, snippet). Null texts have none; a text that breaks off gives what it holds up to there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in FACTS.split(", ")]
        whole = {"arguments": "Int32", "scope_start": "Int32", "scope_end": "Int32"}
        for b in batches:
            rows = [(i, *f) for i, t in zip(b["request_id"], b["snippet"]) for f in facts(t)]
            yield pd.DataFrame(rows, columns=cols).astype(whole)

    found = files.where("snippet is not null").select("request_id", "snippet").mapInPandas(run, FACTS)
    return found.withColumn("symbol", F.when(F.col("kind").isin("lock", "unlock"), lock_name(F.col("symbol"))).otherwise(F.col("symbol")))


def visible(uses: DataFrame, values: DataFrame) -> DataFrame:
    """uses with `binding` (its detail, place) of the value of that name that each sees: declared before, in a scope around; the latest wins, null where none is seen."""
    v = values.select("request_id", F.col("function").alias("vf"), "symbol", F.struct(F.col("start_byte").alias("place"), F.col("detail").alias("what"), "scope_start", "scope_end").alias("v"))
    on = ["request_id", "symbol"]
    seen = (F.col("vf") == F.col("function")) & (F.col("v.place") <= F.col("start_byte")) & F.col("start_byte").between(F.col("v.scope_start"), F.col("v.scope_end"))
    best = uses.join(v, on).where(seen).groupBy(*on, "start_byte").agg(F.max("v").alias("binding"))
    return uses.join(best, [*on, "start_byte"], "left")


def link(found: DataFrame, files: DataFrame) -> DataFrame:
    """request_id, caller, symbol, line, start_byte, kind, target_request, target, resolution of the direct calls in each repository.

    A call of a function pointer that the place sees has the functions put into it before, in its scope, as targets (kind indirect).
    A name that is another value there, or a value of its file, calls no function (shadowed). Else the file's own function of that
    name is meant, else those of other files that aren't internal; a function that fits the number of arguments hides those that
    don't. One target is resolved, several are ambiguous and all kept, none is unresolved. Names are looked up once for each
    repository and not for each call. files: request_id, repo.
    """
    used = found.where("kind in ('call', 'value', 'global', 'reference', 'function')")
    f = Scratch(found.sparkSession).write(used.join(files.select("request_id", "repo"), "request_id"))  # read from many sides
    calls = f.where("kind = 'call' and detail = 'direct'").select("request_id", "repo", "function", "symbol", "line", "start_byte", "arguments")
    placed = visible(calls, f.where("kind = 'value'"))
    file_values = f.where("kind = 'global'").select("request_id", "symbol").distinct().withColumn("of_file", F.lit(True))
    placed = placed.join(file_values, ["request_id", "symbol"], "left")
    pointer = F.col("binding.what") == "function_pointer"
    way = F.when(pointer, "indirect").when(F.col("binding").isNotNull() | F.col("of_file"), "shadowed").otherwise("direct")
    placed = placed.withColumn("kind", way)
    stores = f.where("kind = 'reference'").select("request_id", F.col("function").alias("sf"), F.col("detail").alias("symbol"), F.col("symbol").alias("stored"), F.col("start_byte").alias("at"))
    put = placed.where("kind = 'indirect'").join(stores, ["request_id", "symbol"]).where("sf = function and at < start_byte and at >= binding.place")
    last = put.groupBy("request_id", "start_byte").agg(F.max("at").alias("at"))
    put = put.join(last, ["request_id", "start_byte", "at"])
    asked = placed.where("kind = 'direct'").withColumn("name", F.col("symbol")).select("request_id", "repo", "start_byte", "name", "arguments")
    asked = asked.unionByName(put.select("request_id", "repo", "start_byte", F.col("stored").alias("name"), F.lit(None).cast("int").alias("arguments")))
    defs = f.where("kind = 'function'").select("repo", F.col("symbol").alias("name"), F.col("request_id").alias("target_request"), F.col("arguments").alias("arity"), (F.col("detail") == "internal").alias("internal")).distinct()
    own = asked.select("request_id", "repo", "name", "arguments").distinct()
    near = own.join(defs, ["repo", "name"], "left_semi").join(defs.withColumnRenamed("target_request", "t"), ["repo", "name"])
    near = near.where((F.col("t") == F.col("request_id")) | ~F.col("internal"))
    rank = F.when(F.col("t") == F.col("request_id"), 2).otherwise(0) + F.coalesce((F.col("arity") == F.col("arguments")).cast("int"), F.lit(0))
    key = ["request_id", "repo", "name"]
    near = near.withColumn("rank", rank)
    best = near.groupBy(*key, "arguments").agg(F.max("rank").alias("best"))
    same = lambda a, b: (F.col(f"{a}.request_id") == F.col(f"{b}.request_id")) & (F.col(f"{a}.repo") == F.col(f"{b}.repo")) & (F.col(f"{a}.name") == F.col(f"{b}.name")) & F.col(f"{a}.arguments").eqNullSafe(F.col(f"{b}.arguments"))
    kept = near.alias("n").join(best.alias("b"), same("n", "b")).where("rank = best").select("n.*")
    targets = asked.alias("a").join(kept.alias("k"), same("a", "k")).select("a.request_id", "a.start_byte", "k.t", "a.name").distinct()
    n = targets.groupBy("request_id", "start_byte").agg(F.count(F.lit(1)).alias("n"))
    out = placed.join(n, ["request_id", "start_byte"], "left").join(targets, ["request_id", "start_byte"], "left")
    state = F.when(F.col("n").isNull(), F.when(F.col("kind") == "shadowed", "shadowed").otherwise("unresolved")).when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return out.select("request_id", F.col("function").alias("caller"), "symbol", "line", "start_byte", "kind", F.col("t").alias("target_request"), F.col("name").alias("target"), state.alias("resolution"))


def modified_between(found: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (request_id, function, path, from_byte, to_byte) with `modified`: whether an assignment writes the path, or what it hangs from, in between, or a loop starts there."""
    w = found.where("kind in ('assignment', 'loop')").select("request_id", F.col("function").alias("wf"), F.col("kind").alias("wk"), F.col("symbol").alias("ws"), F.col("start_byte").alias("at"))
    hit = (F.col("wk") == "loop") | (F.col("ws") == F.col("path")) | F.col("path").startswith(F.concat("ws", F.lit("."))) | F.col("ws").startswith(F.concat("path", F.lit(".")))
    key = ["request_id", "function", "path", "from_byte", "to_byte"]
    seen = spans.join(w, "request_id").where((F.col("wf") == F.col("function")) & (F.col("at") > F.col("from_byte")) & (F.col("at") < F.col("to_byte")) & hit).select(*key).distinct().withColumn("m", F.lit(True))
    return spans.join(seen, key, "left").select(*spans.columns, F.coalesce("m", F.lit(False)).alias("modified"))


def public_declarations(found: DataFrame, files: DataFrame) -> DataFrame:
    """repo, name, file_path: functions that a header declares outside. files: request_id, repo, file_path."""
    heads = files.where(F.lower("file_path").rlike(r"\.(h|hh|hpp|hxx)$")).select("request_id", "repo", "file_path")
    return found.where("kind = 'declaration' and detail = 'external'").join(heads, "request_id").select("repo", F.col("symbol").alias("name"), "file_path").distinct()


def entry_points(found: DataFrame, files: DataFrame) -> DataFrame:
    """request_id, function: definitions that others can call (external and declared in a header of the repository, or `main`), or whose name a global's initial value holds."""
    found = Scratch(found.sparkSession).write(found.where("kind in ('function', 'declaration', 'initialiser')"))
    f = found.join(files.select("request_id", "repo"), "request_id")
    defs = f.where("kind = 'function'").select("request_id", "repo", F.col("symbol").alias("name"), F.col("detail").alias("linkage"))
    public = public_declarations(found, files).select("repo", "name").distinct().withColumn("public", F.lit(True))
    held = f.where("kind = 'initialiser'").select("request_id", F.col("symbol").alias("name")).distinct().withColumn("held", F.lit(True))
    met = defs.join(public, ["repo", "name"], "left").join(held, ["request_id", "name"], "left")
    return met.where("held or (linkage = 'external' and (public or name = 'main'))").select("request_id", F.col("name").alias("function")).distinct()


def functions_of(found: DataFrame, files: DataFrame) -> DataFrame:
    """request_id, id, name, arity, linkage, line: one row for each function, its id path::name; of equal ids the first in the file."""
    f = found.where("kind = 'function'").join(files.select("request_id", "file_path"), "request_id")
    first = f.groupBy("request_id", "file_path", "symbol").agg(F.min(F.struct("start_byte", "line", "arguments", "detail")).alias("d"))
    return first.select("request_id", F.concat("file_path", F.lit("::"), "symbol").alias("id"), F.col("symbol").alias("name"), F.col("d.arguments").alias("arity"), F.col("d.detail").alias("linkage"), "d.line")


def sinks(found: DataFrame, table: dict[str, str]) -> DataFrame:
    """request_id, function, call, sink_type: the first sensitive outside call of each function that its own file doesn't define."""
    kinds = found.sparkSession.createDataFrame([(c, k) for k, cs in table.items() for c in cs.split()], "call string, sink_type string")
    own = found.where("kind = 'function'").select("request_id", F.lower("symbol").alias("call")).distinct()
    calls = found.where("kind = 'call' and detail = 'direct'").select("request_id", "function", F.lower("symbol").alias("call"), "start_byte").join(own, ["request_id", "call"], "left_anti").join(kinds, "call")
    first = calls.groupBy("request_id", "function").agg(F.min(F.struct("start_byte", "call", "sink_type")).alias("m"))
    return first.select("request_id", "function", "m.call", "m.sink_type")
