"""Source files that do not parse: token streams, and the derivative parser run over them.

A file is flagged where its derivative becomes empty (the exact failing token) or where its end isn't nullable (it stops too
early). Files are read whole. The common case takes one pattern search and two dictionary steps for each token; files that
fail there, or have conditional compilation, are read again with positions.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grammars
from .derivative import Grammar, Node

# Keywords of each language.
C_TYPES = "auto char const double float int long register restrict short signed static typedef unsigned void volatile inline _Bool _Complex _Noreturn _Thread_local _Atomic __inline __inline__ __restrict __restrict__ __const __volatile__ __signed__ __extension__ __thread"
C_KEYS = "if else while do for switch case default break continue return goto struct union enum sizeof asm"
CPP_TYPES = "bool wchar_t char8_t char16_t char32_t virtual explicit constexpr consteval constinit mutable friend thread_local export"
CPP_KEYS = "class namespace using template typename operator new delete throw try catch decltype concept requires extern"
JS_KEYS = "var let const if else for while do switch case default break continue return function class extends new delete typeof void in import export try catch finally throw yield await debugger with async of static as from"
GO_KEYS = "package import func var const type struct interface map chan if else for range switch select case default go defer return break continue goto fallthrough"
PY_KEYS = "if elif else while for in is not and or lambda try except finally with as def class return raise from import global nonlocal del assert pass break continue async await yield match case type"

_C_SKIP = r"(?>(?:\n|[ \t\r\f\v]+|//(?:\\\r?\n|[^\n])*|/\*(?s:.*?)\*/|\\\r?\n|^[ \t]*\#[ \t]*(?:(?:include|include_next|define|undef|pragma|line|error|warning|ident|import)\b(?:\\\r?\n|/\*(?s:.*?)\*/|[^\n])*|\d+[^\n]*|(?=\r?\n|$)))*)"
_C_OPS = r"\.\.\.|->\*|->|<<=|>>=|<=>|\+\+|--|&&|\|\||::|<<|[-+*/%&|^<>=!]=|[-+*/%&|^~!<>=?:;,.(){}\[\]]"
_C_TOKEN = rf"""{_C_SKIP}(^[ \t]*\#[ \t]*(?:if|ifdef|ifndef|elif|elifdef|elifndef|else|endif)\b(?:\\\r?\n|[^\n])*|(?:u8|[uUL])?R?"(?:[^"\\\n]|\\(?s:.))*"|(?:u8|[uUL])?'(?:[^'\\\n]|\\(?s:.))+'|\.?\d(?:[eEpP][-+]|'\w|[\w.])*|[^\W\d][\w$]*|\$[\w$]*|{_C_OPS}|(?s:.)|\Z)"""
_RAW = re.compile(r'R"([^()\\\s]{0,16})\((?s:.*?)\)\1"')
_JS_BEFORE = r"[=!]==?|&&|\|\||=>|\?\?|[(,=:\[!&|?{};+]|\b(?:return|typeof|case|in|of|void|delete)\b"
_JS_RE = r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_TPL = r"`(?:[^`\\$]|\\(?s:.)|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{(?:[^{}`]|`[^`]*`|\{[^{}`]*\})*\})*\})*`"
_JS_TOKEN = rf"""(?>(?:\s+|//[^\n]*|/\*(?s:.*?)\*/|\A\#![^\n]*)*)(REGEXES{_TPL}|"(?:[^"\\\n]|\\(?s:.))*"|'(?:[^'\\\n]|\\(?s:.))*'|\.?\d(?:[eE][-+]|[\w.])*|\#?[^\W\d][\w$]*|\$[\w$]*|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|\?\.(?!\d)|\?\?|\+\+|--|&&|\|\||\*\*|<<|>>|[-+*/%&|^<>=!]=|(?s:.)|\Z)"""
_GO_TOKEN = r"""(?>[ \t\r\f]+|//[^\n]*|/\*[^\n]*?\*/)*(\n|/\*(?s:.*?)\*/|`[^`]*`|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.[^'\n]*)'|\.?\d(?:[eEpP][-+]|[\w.])*|[^\W\d]\w*|\.\.\.|<<=|>>=|&\^=|&\^|<-|:=|\+\+|--|&&|\|\||<<|>>|[-+*/%&|^<>=!]=|(?s:.))"""
_PY_TOKEN = r"""(?>[ \t\f]+|\\\r?\n)*((?:\#[^\n]*)?(?:\r?\n|\r)(?:[ \t\f]*(?:\#[^\n]*)?(?:\r?\n|\r))*[ \t]*|\#[^\n]*|(?i:f|rf|fr)(?:"(?:[^"\\\n{}]|\\(?s:.)|\{\{|\}\}|\{(?:[^{}\n]|\{[^{}\n]*\})*\})*"(?!")|'(?:[^'\\\n{}]|\\(?s:.)|\{\{|\}\}|\{(?:[^{}\n]|\{[^{}\n]*\})*\})*'(?!'))|(?i:[rbuf]|br|rb|fr|rf)?(?:\"\"\"(?:[^\\"]|\\(?s:.)|"(?!""))*\"\"\"|'''(?:[^\\']|\\(?s:.)|'(?!''))*'''|"(?:[^"\\\n]|\\(?s:.))*"|'(?:[^'\\\n]|\\(?s:.))*')|(?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][-+]?\d[\d_]*)?[jJ]?)|[^\W\d]\w*|\.\.\.|\*\*=|//=|>>=|<<=|:=|->|\*\*|//|<<|>>|[-+*/%&|^@<>=!]=|(?s:.))"""


class Kinds(dict):
    """Token text to its kind, worked out once for each text; emptied when it has grown large."""

    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, t: str):  # dict.__getitem__ comes here too
        if len(self) > 500_000:
            self.clear()
        k = self[t] = self.rule(t)
        return k


def _c_rule(types: set[str], keys: set[str], cpp: bool):
    alias = {"__asm__": "asm", "__asm": "asm", "_Alignof": "sizeof", "alignof": "sizeof", "__alignof__": "sizeof", "co_return": "return"}
    attr = {"__attribute__", "__declspec", "_Alignas", "__attribute"} | ({"alignas", "noexcept"} if cpp else set())

    def rule(t: str):
        c = t[:1]
        if t.lstrip()[:1] == "#" and len(t) > 1:
            return "#" + re.match(r"\s*#\s*(\w+)", t)[1]
        if c.isalpha() or c in "_$":
            if t[-1] in "\"'" and len(t) > 1:
                return "STR" if t[-1] == '"' else "CHR"
            t = alias.get(t, t)
            if t in types:
                return "T"
            if t in keys:
                return t
            if t in attr:
                return "ATTR"
            if cpp and t in ("public", "private", "protected"):
                return "ACCESS"
            if cpp and t in ("co_await", "co_yield"):
                return "EXT"
            return "ID"
        if c == '"':
            return "STR" if len(t) > 1 else "BAD"
        if c == "'":
            return "CHR" if len(t) > 1 else "BAD"
        if c.isdigit() or (c == "." and t[1:2].isdigit()):
            return "NUM"
        if t in ("(", ")", "[", "]", "{", "}", ";", ",", ":", "?", ".", "->", "...", "=", "*", "&", "&&", "-", "+", "<", ">", "!", "~", "++", "--"):
            return t
        if t == "::":
            return "::" if cpp else "BAD"
        if t in ("->*", "<=>"):
            return "BIN" if cpp else "BAD"
        return "BIN" if t in ("/", "%", "|", "^", "||", "<<", "<<=", ">>=") or (len(t) == 2 and t[1] == "=") else "BAD"

    return rule


def _js_rule(t: str):
    c = t[0]
    if c.isalpha() or c in "_$" or ord(c) > 127:
        if "/" in t:
            head = re.match(r"\w+", t)[0]
            return (_js_rule(head), "REGEX")
        if t in ("instanceof",):
            return "BIN"
        return t if t in _JS else "ID" if re.fullmatch(r"[\w$]+", t) else "BAD"
    if c == "#":
        return "PRIVATE" if len(t) > 1 else "BAD"
    if c == "`":
        return "TPL" if len(t) > 1 else "BAD"
    if c in "\"'":
        return "STR" if len(t) > 1 else "BAD"
    if c.isdigit() or (c == "." and t[1:2].isdigit()):
        return "NUM"
    if t[-1:] != c and "/" in t[1:] and t not in ("/=",):
        m = re.match(_JS_BEFORE, t)
        return (_js_rule(m[0]), "REGEX")
    if t in ("(", ")", "[", "]", "{", "}", ";", ",", ":", "?", ".", "?.", "...", "=", "=>", "*", "-", "+", "/", "!", "++", "--", "@"):
        return t
    if t == "~":
        return "!"
    return "BIN" if len(t) > 1 or t in "%<>&|^" else "BAD"


def _go_rule(t: str):
    c = t[0]
    if t == "\n" or (t[:2] == "/*" and "\n" in t):
        return "NL" if len(t) == 1 or t.endswith("*/") else "BAD"
    if c.isalpha() or c == "_" or ord(c) > 127:
        return t if t in _GO else "ID" if t.isidentifier() else "BAD"
    if c in "\"`":
        return "STR" if len(t) > 1 else "BAD"
    if c == "'":
        return "CHR" if len(t) > 1 else "BAD"
    if c.isdigit() or (c == "." and t[1:2].isdigit()):
        return "NUM"
    if t in ("(", ")", "[", "]", "{", "}", ";", ",", ":", ".", "...", ":=", "=", "*", "&", "-", "+", "^", "|", "<-", "!", "~", "++", "--"):
        return t
    if t in ("==", "!=", "<=", ">=", "&&", "||", "<<", ">>", "&^", "/", "%", "<", ">"):
        return "BIN"
    return "ASG" if len(t) > 1 and t[-1] == "=" else "BAD"


def _py_rule(t: str):
    c = t[0]
    if c == "#" and "\n" not in t and "\r" not in t:
        return "SKIP"
    if c in "#\r\n":
        return "NL"
    if c.isalpha() or c == "_" or ord(c) > 127:
        if t[-1] in "\"'":
            return "STR"
        return "CONST" if t in ("None", "True", "False") else t if t in _PY else "ID" if t.isidentifier() else "BAD"
    if c in "\"'":
        return "STR" if len(t) > 1 else "BAD"
    if c.isdigit() or (c == "." and t[1:2].isdigit()):
        return "NUM"
    if t in ("(", ")", "[", "]", "{", "}", ";", ",", ":", ".", "...", "=", ":=", "->", "*", "**", "-", "+", "@", "~", "/"):
        return "BIN/" if t == "/" else t
    if t in ("==", "!=", "<=", ">=", "<<", ">>", "//", "%", "<", ">", "&", "|", "^"):
        return "BIN"
    return "AUG" if len(t) > 1 and t[-1] == "=" else "BAD"


_JS, _GO, _PY = set(JS_KEYS.split()), set(GO_KEYS.split()), set(PY_KEYS.split())
_C = set(C_KEYS.split())
_GO_ENDS = {"ID", "NUM", "STR", "CHR", ")", "]", "}", "++", "--", "return", "break", "continue", "fallthrough"}
_OPEN, _CLOSE = {"(", "[", "{"}, {")", "]", "}"}


class Fault(Exception):
    """kind (unexpected or truncated), offset, token."""


class Language:
    def __init__(self, name: str, token: str, rule, ebnf: str):
        self.name, self.token, self.kinds = name, re.compile(token, re.M), Kinds(rule)
        self.grammar = Grammar(ebnf, "tu")

    def _step(self, node: Node, k) -> Node:
        if type(k) is tuple:
            for x in k:
                node = self._step(node, x)
            return node
        got = node.d.get(k)
        return got if got is not None else self.grammar.derive(node, k)

    def fast(self, text: str) -> bool:
        """Whether the text parses without anything that needs positions. False only means that `slow` must look."""
        kinds, g = self.kinds, self.grammar
        node, empty = g.start, g.empty
        toks = self.token.findall(text)
        while toks and not toks[-1]:
            toks.pop()
        for k in map(kinds.__getitem__, toks):
            got = node.d.get(k)
            if got is None:
                got = self._step(node, k)
                if got is empty:
                    return False
            node = got
        return node.null

    def slow(self, text: str) -> None:
        """Raise the text's Fault, if it has one."""
        node, g = self.grammar.start, self.grammar
        for m in self.token.finditer(text):
            t = m.group(1)
            if not t:
                continue
            got = self._step(node, self.kinds[t])
            if got is g.empty:
                raise Fault("unexpected", m.start(1), t)
            node = got
        if not node.null:
            raise Fault("truncated", len(text), "")

    def check(self, text: str) -> None:
        if len(self.grammar.made) > self.grammar.limit:
            self.grammar.reset()
        text = text.removeprefix("﻿").rstrip("\0 \t\r\n\f\v") + "\n"
        if not self.fast(text):
            self.slow(text)


class CFamily(Language):
    def check(self, text: str) -> None:
        if 'R"' in text:
            text = _RAW.sub(lambda m: '"' + "x" * (len(m[0]) - 2) + '"', text)
        super().check(text)

    def slow(self, text: str) -> None:
        """Conditional branches all go on from the state before #if; what follows #endif may go on from any of their ends."""
        g = self.grammar
        node, stack = g.start, []
        for m in self.token.finditer(text):
            t = m.group(1)
            k = self.kinds[t] if t else None
            if k is None:
                continue
            if k[0] == "#":
                word = k[1:]
                if word.startswith("if"):
                    off = bool(re.match(r"\s*#\s*if\s+(?:0|false)\s*(?:/|$)", t))
                    stack.append([node, [], False, off, node is None])
                    node = None if off or node is None else node
                elif not stack:
                    raise Fault("unexpected", m.start(1), t)
                elif word == "endif":
                    before, ends, any_else, _, dead = stack.pop()
                    ends = [e for e in [*ends, node, None if any_else else before] if e is not None]
                    node = None if dead else g.alt(ends) if ends else before
                else:
                    top = stack[-1]
                    top[1].append(node)
                    top[2] |= word == "else"
                    node = top[0]
                continue
            if node is None:
                continue
            got = self._step(node, k)
            if got is g.empty:
                raise Fault("unexpected", m.start(1), t)
            node = got
        if stack or not node.null:
            raise Fault("truncated", len(text), "")


class JavaScript(Language):
    """A regular expression can only stand after some tokens; texts without such a place are read with a simpler pattern."""

    def __init__(self, name: str, token: str, rule, ebnf: str):
        super().__init__(name, token.replace("REGEXES", rf"(?:{_JS_BEFORE})\s*{_JS_RE}|"), rule, ebnf)
        self.plain, self.full = re.compile(token.replace("REGEXES", ""), re.M), self.token
        self.place = re.compile(rf"(?:{_JS_BEFORE})\s*/(?![*/])")

    def check(self, text: str) -> None:
        self.token = self.full if self.place.search(text) else self.plain
        super().check(text)

    def slow(self, text: str) -> None:
        """With semicolons put in where the grammar needs one and a line, a block or the text ends."""
        g = self.grammar
        node, last = g.start, 0
        for m in self.token.finditer(text):
            t = m.group(1)
            if not t:
                continue
            k = self.kinds[t]
            got = self._step(node, k)
            if got is g.empty and (k == "}" or "\n" in text[last : m.start(1)]):
                got = self._step(self._step(node, ";"), k)
            if got is g.empty:
                raise Fault("unexpected", m.start(1), t)
            node, last = got, m.end()
        if not node.null and not self._step(node, ";").null:
            raise Fault("truncated", len(text), "")


class Go(Language):
    def fast(self, text: str) -> bool:
        g, kinds, step = self.grammar, self.kinds, self._step
        node, last, empty, ends = g.start, None, g.empty, _GO_ENDS
        for k in map(kinds.__getitem__, self.token.findall(text)):
            if k == "NL":
                if last not in ends:
                    continue
                k = ";"
            got = node.d.get(k)
            if got is None:
                got = step(node, k)
                if got is empty:
                    return False
            node, last = got, k
        return node.null

    def slow(self, text: str) -> None:
        node, last, g = self.grammar.start, None, self.grammar
        for m in self.token.finditer(text):
            k = self.kinds[m.group(1)]
            if k == "NL":
                if last not in _GO_ENDS:
                    continue
                k = ";"
            got = self._step(node, k)
            if got is g.empty:
                raise Fault("unexpected", m.start(1), m.group(1))
            node, last = got, k
        if not node.null:
            raise Fault("truncated", len(text), "")


class Python(Language):
    def _layout(self, toks) -> Iterator[tuple[int, str]]:
        """(number of the token, kind), with NEWLINE, INDENT and DEDENT put in; WRONG where a line's indentation fits no open block."""
        kinds, depth, indents, fresh, width = self.kinds, 0, [0], True, 0
        for i, t in enumerate(toks):
            k = kinds[t]
            if k == "NL":
                if not depth:
                    if not fresh:
                        yield i, "NEWLINE"
                    fresh = True
                    width = len(t[max(t.rfind("\n"), t.rfind("\r")) + 1 :].expandtabs(8))
                continue
            if k == "SKIP":
                continue
            if fresh:
                if width > indents[-1]:
                    indents.append(width)
                    yield i, "INDENT"
                while width < indents[-1]:
                    indents.pop()
                    yield i, "DEDENT"
                if width != indents[-1]:
                    yield i, "WRONG"
                fresh = False
            if k in _OPEN:
                depth += 1
            elif k in _CLOSE:
                depth -= 1
            yield i, k
        if not fresh:
            yield len(toks), "NEWLINE"
        for _ in indents[1:]:
            yield len(toks), "DEDENT"

    def _parse(self, toks) -> tuple[int, bool] | None:
        """(number of the failing token, whether it is the end), or None."""
        node, empty, step = self.grammar.start, self.grammar.empty, self._step
        for i, k in self._layout(toks):
            got = node.d.get(k)
            if got is None:
                got = step(node, k)
                if got is empty:
                    return i, i == len(toks)
            elif got is empty:
                return i, i == len(toks)
            node = got
        return None if node.null else (len(toks), True)

    def fast(self, text: str) -> bool:
        return self._parse(self.token.findall("\n" + text)) is None

    def slow(self, text: str) -> None:
        found = list(self.token.finditer("\n" + text))
        at, ended = self._parse([m.group(1) for m in found]) or (len(found), True)
        if ended:
            raise Fault("truncated", len(text), "")
        raise Fault("unexpected", max(0, found[at].start(1) - 1), found[at].group(1))


_BUILD = {
    "c": lambda: CFamily("c", _C_TOKEN, _c_rule(set(C_TYPES.split()) | {"extern"}, _C, False), grammars.C),
    "cpp": lambda: CFamily("cpp", _C_TOKEN, _c_rule(set(C_TYPES.split()) | set(CPP_TYPES.split()), _C | set(CPP_KEYS.split()), True), grammars.CPP),
    "javascript": lambda: JavaScript("javascript", _JS_TOKEN, _js_rule, grammars.JS),
    "go": lambda: Go("go", _GO_TOKEN, _go_rule, grammars.GO),
    "python": lambda: Python("python", _PY_TOKEN, _py_rule, grammars.PYTHON.replace("'/' |", "'BIN/' |").replace("bin = BIN", "bin = BIN | 'BIN/'")),
}
_ready: dict[str, Language] = {}


def fault(language: str, text: str) -> Fault | None:
    """The text's syntax fault in a language, or None. Languages without a grammar have none."""
    if language not in _BUILD:
        return None
    if language not in _ready:
        _ready[language] = _BUILD[language]()
    limit = sys.getrecursionlimit()
    try:
        _ready[language].check(text)
    except Fault as e:
        return e
    except RecursionError:  # a derivative of deep nesting is deep itself: once more with room for it
        _ready[language].grammar.reset()
        try:
            sys.setrecursionlimit(max(limit, 1000 + 200 * len(text)))
            _ready[language].check(text)
        except Fault as e:
            return e
        finally:
            sys.setrecursionlimit(limit)
            _ready[language].grammar.reset()
    return None


CHECKED = "request_id bigint, repo string, language string, valid boolean, fault string, line int, token string"


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = [c.split()[0] for c in CHECKED.split(", ")]
    for b in batches:
        out = []
        for i, repo, lang, text in zip(b["request_id"], b["repo"], b["language"], b["snippet"]):
            f = fault(lang, text)
            if f is None:
                out.append((i, repo, lang, True, None, None, None))
            else:
                kind, at, token = f.args
                out.append((i, repo, lang, False, kind, text.count("\n", 0, at) + 1, token))
        yield pd.DataFrame(out, columns=cols)


def checked(requests: DataFrame) -> DataFrame:
    """CHECKED of each distinct request; `requests` has request_id, repo, language and snippet.

    Null or blank snippets, null ids and languages without a grammar have no row. Repeated rows count once.
    """
    rows = requests.where(F.col("request_id").isNotNull() & F.col("language").isin(*_BUILD) & F.col("snippet").rlike(r"(?U)\S"))
    return rows.select("request_id", "repo", "language", "snippet").mapInPandas(_check, CHECKED).distinct()


def rates(done: DataFrame) -> DataFrame:
    """repo, language, files, broken, truncated, rate."""
    g = done.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("broken"), F.count_if(F.col("fault") == "truncated").alias("truncated"))
    return g.withColumn("rate", F.col("broken") / F.col("files"))
