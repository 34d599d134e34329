"""Where quoted code stands in its file: function spans, snippet location, anchors of snippets and chunks.

Findings are gathered by file before they meet its text, at most SHARD to a row, so a text is moved and indexed once for so many
findings and a file that a third of all findings name is spread over many rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import c_facts

#: Findings that share one copy of their file's text.
SHARD = 500
# Shortest line that tells one place from another, lines that never do, least window in lines, how quoted lines are numbered.
TELLING, BRACES, LEAST_WINDOW = 8, {"{", "}", "};"}, 3
NUMBER = re.compile(r"^\s*(\d+):\s?")
C_ENDINGS = r"\.(c|h|cc|cpp|cxx|hpp|hh|hxx)$"
ANCHOR = "confidence string, first_line int, last_line int, start_byte int, end_byte int, symbol string, content_hash string"


def function_spans(text: str) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of the functions of a C or C++ text, in order."""
    return [(d.name, d.line, d.last_line) for d in c_facts.definitions(c_facts.masked(text.replace("\r\n", "\n")))]


def nearest_span(spans: list[tuple[str, int, int]], line: int, name: str | None = None) -> tuple[int, int] | None:
    """The span that holds a line, else the one that starts nearest to it."""
    some = [(not a <= line <= z, abs(a - line), a, z) for n, a, z in spans if name in (None, n)]
    return min(some)[2:] if some else None


def function_text(lines: list[str], spans: list[tuple[str, int, int]], line: int, max_chars: int = 6000, otherwise: int = 80) -> str:
    """The numbered lines from a line to the end of its function, as many whole lines as the budget holds; without a function, so many lines from there on."""
    if not lines:
        return ""
    _, last = nearest_span(spans, line) or (line, line + otherwise)
    first = min(max(line, 1), len(lines))
    last = max(first, min(last, len(lines)))
    shown = [f"{n:>{len(str(last))}}: {lines[n - 1]}" for n in range(first, last + 1)]
    fits = bisect_right(list(accumulate((len(x) + 1 for x in shown), initial=-1))[1:], max_chars)
    return "\n".join(shown[:fits]) if fits else shown[0][:max_chars]


class Located:
    """One file's text, ready to be searched for many snippets."""

    def __init__(self, text: str, c_family: bool = False):
        self.lines = text.splitlines()
        self.folded = [" ".join(x.split()) for x in self.lines]
        # the same text twice as one string, with where each line starts in it: line ends kept, and all white space folded
        self.tight = "\n".join(x.rstrip() for x in self.lines)
        self.tight_at = list(accumulate((len(x.rstrip()) + 1 for x in self.lines), initial=0))
        self.fluid = "".join(x + " " for x in self.folded if x)
        self.fluid_at = list(accumulate((len(x) + 1 if x else 0 for x in self.folded), initial=0))
        self.bytes_at = list(accumulate((len(x.encode("utf-8", "replace")) for x in text.splitlines(keepends=True)), initial=0))
        self.ends = [a + len(x.encode("utf-8", "replace")) for a, x in zip(self.bytes_at, self.lines)]
        self.raw = text.encode("utf-8", "replace")
        self._c, self._spans, self._places = c_family, None, None

    @property
    def spans(self) -> list[tuple[str, int, int]]:
        if self._spans is None:
            self._spans = function_spans("\n".join(self.lines)) if self._c else []
        return self._spans

    def symbol(self, line: int) -> str | None:
        """The function around a line, the innermost."""
        around = [(a, n) for n, a, z in self.spans if a <= line <= z]
        return max(around)[1] if around else None

    def holds(self, first: int, last: int, quote: str) -> bool:
        """Whether the lines hold the quote, or the quote the lines, but for white space."""
        if not 1 <= first <= last <= len(self.lines):
            return False
        quote, there = " ".join(quote.split()), self.fluid[self.fluid_at[first - 1] : self.fluid_at[last]].strip()
        return bool(quote) and (quote in there or there in quote)

    def verbatim(self, quote: list[str]) -> list[tuple[int, int]]:
        """First and last line of each place where the quoted lines stand, but for white space at line ends."""
        starts = (m.start() for m in re.finditer(f"(?={re.escape(chr(10).join(quote))})", self.tight))
        return [(n, n + len(quote) - 1) for n in (bisect_right(self.tight_at, s) for s in starts)]

    def scattered(self, quote: list[str], hint: range) -> tuple[int, int] | None:
        """The lines between which most of the quote's telling lines stand; of equal windows one at the hint, else the first."""
        if self._places is None:
            self._places = {}
            for n, x in enumerate(self.folded, 1):
                self._places.setdefault(x, []).append(n)
        telling = [x for x in (" ".join(q.split()) for q in quote) if len(x) >= TELLING and x not in BRACES]
        hits = np.sort(np.array([n for x in telling for n in self._places.get(x, ())], np.int64))
        if not len(hits):
            return None
        width = max(len(quote), LEAST_WINDOW)
        opens = np.searchsorted(hits, hits - width)
        count = np.arange(len(hits)) - opens
        full = np.flatnonzero(count == count.max())
        near = [i for i in full if int(hits[i]) in hint] or full
        start = int(hits[opens[full[0] if int(hits[opens[full[0]]]) in hint else near[0]]])
        inside = hits[(hits >= start) & (hits <= start + width)]
        return int(inside[0]), int(inside[-1])

    def find(self, snippet: str, first: int | None = None, last: int | None = None, context: str = "") -> tuple[str, int | None, int | None]:
        """(confidence, first line, last line).

        exact: the given lines hold the snippet, or it stands in the text once. disambiguated: it stands there more than once;
        places that touch the given lines come first, then those in a function that the context names, then the order in the text.
        fuzzy: lines of it stand close together. unresolved: nothing matches, or there is nothing to match.
        """
        quotes, hint = [snippet], range(0)
        if first is not None and last is not None:
            hint = range(first, last + 1)
            numbered = [NUMBER.match(x) for x in snippet.splitlines()]
            if len(numbered) == len(hint) and all(m and int(m[1]) == n for m, n in zip(numbered, hint)):
                quotes.append("\n".join(x[m.end() :] for m, x in zip(numbered, snippet.splitlines())))
            if any(self.holds(first, last, q) for q in quotes):
                return "exact", first, last
        for q in quotes:
            lines = [x.rstrip() for x in q.splitlines()]
            solid = [i for i, x in enumerate(lines) if x]
            if not solid:
                continue
            lines = lines[solid[0] : solid[-1] + 1]
            if places := self.verbatim(lines):
                if len(places) == 1:
                    return "exact", *places[0]
                named = (lambda p: (s := self.symbol(p[0])) is not None and s.split("::")[-1] in context) if context else (lambda p: False)
                return "disambiguated", *min(places, key=lambda p: (p[0] not in hint and p[1] not in hint, not named(p), p))
            if got := self.scattered(lines, hint):
                return "fuzzy", *got
        return "unresolved", None, None

    def anchor(self, confidence: str, first: int | None, last: int | None) -> tuple:
        """The fields of ANCHOR. The hash does not change with white space."""
        if first is None:
            return confidence, None, None, None, None, None, None
        a, z = self.bytes_at[first - 1], self.ends[last - 1]
        text = " ".join(self.raw[a:z].decode("utf-8", "replace").split())
        return confidence, first, last, a, z, self.symbol(first), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:16]


def gathered(findings: DataFrame, files: DataFrame) -> DataFrame:
    """path, source, asked: each file's text with up to about SHARD findings (finding_id, path, code_snippet, start_line, end_line, context) to a row."""
    n = findings.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards")).where("shards > 1")
    spread = findings.join(n, "path", "left").withColumn("shard", F.pmod(F.xxhash64("finding_id"), F.coalesce("shards", F.lit(1))))
    asked = spread.groupBy("path", "shard").agg(F.collect_list(F.struct("finding_id", "code_snippet", "start_line", "end_line", "context")).alias("asked"))
    return asked.join(files.select("path", "source"), "path", "left").select("path", "source", "asked")


def _whole(x) -> int | None:
    """A number that came through a column with nulls."""
    return None if x is None or x != x else int(x)


def locate_snippets(findings: DataFrame, files: DataFrame) -> DataFrame:
    """finding_id and ANCHOR: findings (finding_id, path, code_snippet, start_line, end_line, context) in files (path, source).

    One equi-join on the path. A finding without a file or path, or with a null snippet or source, is unresolved.
    """
    cols = ["finding_id", *(c.split()[0] for c in ANCHOR.split(", "))]
    whole = {c: "Int32" for c in ("first_line", "last_line", "start_byte", "end_byte")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, source, asked in zip(b["path"], b["source"], b["asked"]):
                here = Located(source, bool(re.search(C_ENDINGS, path or "", re.I))) if source else None
                for x in asked:
                    got = here.find(x["code_snippet"], _whole(x["start_line"]), _whole(x["end_line"]), x["context"] or "") if here and x["code_snippet"] else ("unresolved", None, None)
                    out.append((x["finding_id"], *(here.anchor(*got) if here else (*got, None, None, None, None))))
            yield pd.DataFrame(out, columns=cols).astype(whole)

    return gathered(findings, files).mapInPandas(run, f"finding_id bigint, {ANCHOR}")


def stable_id(path, symbol, content_hash):
    """A column that names an anchor without its line: path#symbol~hash."""
    return F.concat(path, F.lit("#"), F.coalesce(symbol, F.lit("")), F.lit("~"), content_hash)


def chunk_anchors(files: DataFrame, chunks: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk and ANCHOR of each chunk (key, chunk, chunk_text) in its own file: a file's chunks are found in order, each from where the one before starts."""
    whole = {c: "Int32" for c in ("first_line", "last_line", "start_byte", "end_byte")}
    cols = [key, "chunk", *(c.split()[0] for c in ANCHOR.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, source, path, parts in zip(b[key], b[text], b["path"], b["parts"]):
                here, at = Located(source, bool(re.search(C_ENDINGS, path or "", re.I))), 0
                raw = here.raw
                for p in sorted(parts, key=lambda x: x["chunk"]):
                    found = raw.find(p["chunk_text"].encode("utf-8", "replace"), at)
                    if found < 0 or not p["chunk_text"]:
                        out.append((k, p["chunk"], *here.anchor("unresolved", None, None)))
                        continue
                    at = found
                    end = found + max(1, len(p["chunk_text"].encode("utf-8", "replace")))
                    out.append((k, p["chunk"], *here.anchor("exact", bisect_right(here.bytes_at[:-1], found), max(1, bisect_right(here.bytes_at[:-1], end - 1)))))
            yield pd.DataFrame(out, columns=cols).astype(whole)

    parts = chunks.where("chunk_text is not null").groupBy(key).agg(F.collect_list(F.struct("chunk", "chunk_text")).alias("parts"))  # as long as the file
    return files.select(key, text, "path").join(parts, key).mapInPandas(run, f"{key} bigint, chunk int, {ANCHOR}")


def functions_at(findings: DataFrame, files: DataFrame, max_chars: int = 6000) -> DataFrame:
    """finding_id, first_line, last_line, shown: the function at each finding's line (finding_id, path, line) and its numbered lines within the budget."""
    asked = findings.select("finding_id", "path", F.lit(None).cast("string").alias("code_snippet"), F.col("line").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit("").alias("context"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for source, asked in zip(b["source"], b["asked"]):
                here = Located(source or "", True)
                for x in asked:
                    if (line := _whole(x["start_line"])) is not None:
                        a, z = nearest_span(here.spans, line) or (None, None)
                        out.append((x["finding_id"], a, z, function_text(here.lines, here.spans, line, max_chars)))
            yield pd.DataFrame(out, columns=["finding_id", "first_line", "last_line", "shown"]).astype({"first_line": "Int32", "last_line": "Int32"})

    return gathered(asked, files).mapInPandas(run, "finding_id bigint, first_line int, last_line int, shown string")
