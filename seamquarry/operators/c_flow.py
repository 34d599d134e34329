"""Scopes, values and conditions in one C or C++ function, over masked text. Positions are those of the text."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

_BRACE = re.compile(r"[{}]")
_TEST = re.compile(r"\b(if|while|for)\s*\(")
_LABEL = re.compile(r"\bgoto\b|(?:^|[;{}])\s*(?!default\b)[A-Za-z_]\w*\s*:(?!:)", re.M)
_TYPE = r"(?:(?:const|volatile|static|register|extern|unsigned|signed|long|short|struct|union|enum|auto)\s+)*[A-Za-z_]\w*(?:::\w+)*(?:\s*<[^<>;{}]*>)?"
_VALUE = re.compile(rf"(?:(?<=[;{{}}(])|^)\s*({_TYPE})((?:\s*[*&]+\s*(?:const\b\s*)?|\s+))([A-Za-z_]\w*)\s*(?=[=;,\[:)])", re.M)
_POINTER = re.compile(rf"(?:(?<=[;{{}}(,])|^)\s*{_TYPE}\s*[*]*\s*\(\s*\*+\s*([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*\)\s*\(", re.M)
_SET = re.compile(r"([A-Za-z_]\w*(?:\s*(?:->|\.)\s*\w+)*)\s*(?:\[[^\]]*\]\s*)?=(?!=)\s*([^;,{}]*)")
_FUNCTION = re.compile(r"^&?\s*((?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)$")
_LEAVES = re.compile(r"^\{?\s*(?:[^;{}]*;\s*)*?(?:return\b[^;]*|break|continue|goto\b[^;]*|exit\s*\([^;]*\)|abort\s*\(\s*\)|throw\b[^;]*)\s*;\s*\}?\s*$")
_PATH = re.compile(r"^[A-Za-z_]\w*(?:(?:\.|\[\w+\])\w*)*$")
# Words that no value or type is called, and how a null is written.
NO_TYPE = set("return else case goto throw new delete sizeof typedef using namespace if while for do switch".split())
NULLS = {"NULL", "nullptr", "0"}


def folded(expression: str) -> str:
    """Syntax without white space that says nothing; `->` as a dot."""
    v = re.sub(r"\s*(::|->|[()\[\]*&.,!<>=+|-])\s*", r"\1", " ".join(expression.split()))
    return v.replace("->", ".")


def blocks(m: str, start: int, end: int) -> list[tuple[int, int]]:
    """The brace blocks within a body, and the body itself, each as (start, end)."""
    out, open_ = [(start, end)], []
    for b in _BRACE.finditer(m, start, end):
        if b[0] == "{":
            open_.append(b.end())
        elif open_:
            out.append((open_.pop(), b.start()))
    return out


def innermost(spans: list[tuple[int, int]], at: int) -> tuple[int, int]:
    return max(s for s in spans if s[0] <= at <= s[1])


def values(m: str, start: int, end: int, spans: list[tuple[int, int]]) -> Iterator[tuple[str, str, int, int, int]]:
    """(name, value or function_pointer, place, scope start, scope end) of the values declared in a body."""
    for kind, pattern, group in (("function_pointer", _POINTER, 1), ("value", _VALUE, 3)):
        for d in pattern.finditer(m, start, end):
            if kind == "value" and d[1].split()[0] in NO_TYPE:
                continue
            yield d[group], kind, d.start(group), *innermost(spans, d.start(group))


def choices(expression: str) -> list[str]:
    """The names an expression stands for: a bare or addressed name, or those of both branches of a conditional."""
    e = expression.strip()
    while e.startswith("(") and e.endswith(")"):
        e = e[1:-1].strip()
    if (q := e.find("?")) >= 0 and (c := e.rfind(":")) > q:
        return choices(e[q + 1 : c]) + choices(e[c + 1 :])
    got = _FUNCTION.match(e)
    return [got[1]] if got and got[1] not in NULLS else []


def stores(m: str, start: int, end: int) -> Iterator[tuple[str, str, int]]:
    """(target, name, place) of each assignment whose value can be a function's name."""
    for a in _SET.finditer(m, start, end):
        for name in choices(a[2]):
            yield folded(a[1]), name, a.start()


@dataclass
class Branch:
    """A span in which a condition held when it was entered."""

    start: int
    end: int
    condition: str
    holds: bool
    guard: bool
    at: int


def _statement(m: str, at: int, end: int, closing) -> tuple[int, int]:
    """The span of the statement at a place: a block, or up to its semicolon."""
    while at < end and m[at].isspace():
        at += 1
    if at < end and m[at] == "{":
        z = closing(m, at)
        return at, (z + 1 if 0 <= z <= end else end)
    if t := _TEST.match(m, at, end):
        z = closing(m, t.end() - 1)
        if 0 <= z < end:
            _, z = _statement(m, z + 1, end, closing)
            if e := re.compile(r"\s*else\b").match(m, z, end):
                _, z = _statement(m, e.end(), end, closing)
            return at, z
    depth = 0
    for i in range(at, end):
        depth += (m[i] in "([{") - (m[i] in ")]}")
        if m[i] == ";" and not depth:
            return at, i + 1
    return at, end


def branches(m: str, start: int, end: int, spans: list[tuple[int, int]], closing) -> list[Branch]:
    """Where in a body which condition is known: in the branches of if, in the body of while and for, and after a guard that leaves
    when its condition holds (or doesn't, by its else), up to the end of the guard's block. A label or goto in the body disables guards."""
    out, jumps = [], bool(_LABEL.search(m, start, end))
    for t in _TEST.finditer(m, start, end):
        z = closing(m, t.end() - 1)
        if not 0 <= z < end:
            continue
        parts = m[t.end() : z].split(";")
        if t[1] == "for" and len(parts) != 3:
            continue
        condition = folded(parts[1] if t[1] == "for" else m[t.end() : z])
        a, b = _statement(m, z + 1, end, closing)
        out.append(Branch(a, b, condition, True, False, t.start()))
        if t[1] != "if":
            continue
        other = re.compile(r"\s*else\b").match(m, b, end)
        last = b
        if other:
            c, last = _statement(m, other.end(), end, closing)
            out.append(Branch(c, last, condition, False, False, t.start()))
        rest = innermost(spans, t.start())[1]
        if not jumps and last < rest:
            if _LEAVES.match(m[a:b]):
                out.append(Branch(last, rest, condition, False, True, t.start()))
            elif other and _LEAVES.match(m[c:last]):
                out.append(Branch(last, rest, condition, True, True, t.start()))
    return out


def _top(expression: str, operator: str) -> list[str]:
    """The parts of an expression between the operators that no bracket encloses."""
    parts, depth, at, i = [], 0, 0, 0
    while i < len(expression):
        depth += (expression[i] in "([{") - (expression[i] in ")]}")
        if not depth and expression.startswith(operator, i):
            parts.append(expression[at:i])
            i += len(operator)
            at = i
        else:
            i += 1
    return [*parts, expression[at:]]


def _bare(expression: str) -> str:
    """An expression without brackets around all of it."""
    e = expression.strip()
    while e.startswith("(") and e.endswith(")"):
        depths = list(itertools.accumulate((c == "(") - (c == ")") for c in e))
        if 0 in depths[:-1]:
            break
        e = e[1:-1].strip()
    return e


def null_facts(condition: str, holds: bool) -> set[tuple[str, bool]]:
    """(path, whether it is null) of what must be so when a condition holds or doesn't, through !, &&, ||, == and !=."""
    e = _bare(condition)
    for operator, splits in (("||", not holds), ("&&", holds)):
        parts = _top(e, operator)
        if len(parts) > 1:
            each = [null_facts(p, holds) for p in parts]
            return set.union(*each) if splits else set.intersection(*each)
    if e.startswith("!") and not e.startswith("!="):
        return null_facts(e[1:], not holds)
    for operator, same in (("==", True), ("!=", False)):
        parts = _top(e, operator)
        if len(parts) == 2:
            a, b = map(_bare, parts)
            path = b if a in NULLS else a if b in NULLS else None
            return {(path, holds == same)} if path and _PATH.match(path) else set()
    return {(e, not holds)} if _PATH.match(e) and e not in NULLS else set()


def written(m: str, path: str, start: int, end: int) -> bool:
    """Whether something between two places writes the path, what it hangs from, or takes its address."""
    for name in {re.escape(path), re.match(r"\w+", path)[0]}:
        shown = name.replace(r"\.", r"\s*(?:->|\.)\s*")
        if re.compile(rf"(?<![\w.>])(?:&\s*{shown}\b|(?:\+\+|--)\s*{shown}\b|{shown}\s*(?:\+\+|--|(?:[-+*/%&|^]|<<|>>)?=(?!=)))").search(m, start, end):
            return True
    return False


def known(m: str, at: int, all_branches: list[Branch]) -> tuple[list[tuple[str, bool, bool]], set[tuple[str, bool]]]:
    """([(condition, holds, by a guard)], null facts) at a place; a fact that is written between its test and the place is gone."""
    here = [b for b in all_branches if b.start <= at < b.end]
    facts = {(p, n) for b in here for p, n in null_facts(b.condition, b.holds) if not written(m, p, b.start, at)}
    return [(b.condition, b.holds, b.guard) for b in here], facts
