"""Parsing with derivatives, memoised.

A grammar is a graph of hash-consed expressions. The derivative of an expression by a token is the expression for what may
follow that token; each is computed once and kept at its node, so a parser that has seen a construct before takes one
dictionary step for each token. An empty derivative marks the token that cannot be there; an end in an expression that isn't
nullable means that the text stops too early.

Grammars are written in EBNF: 'x' or UPPER is a token, lower case a rule, ANYTOK any token but a bracket, [x] optional, {x} repeated, | alternatives.
Rules must not be left-recursive.
"""

from __future__ import annotations

import re

_EBNF = re.compile(r"'([^']*)'|([A-Za-z_][A-Za-z_0-9]*)|([\[\]{}()|=;])")

_BRACKETS = frozenset("()[]{}")


class Node:
    __slots__ = ("kind", "x", "y", "null", "d")

    def __init__(self, kind: str, x=None, y=None, null: bool = False):
        self.kind, self.x, self.y, self.null, self.d = kind, x, y, null, {}


class Grammar:
    """The interned expressions of one language. `start` is the expression for a whole text."""

    def __init__(self, ebnf: str, start: str, limit: int = 400_000):
        self.ebnf, self.top, self.limit = ebnf, start, limit
        self.reset()

    def reset(self) -> None:
        """Drop all memory of earlier texts; results don't depend on it."""
        self.made: dict = {}
        self.empty, self.eps = Node("0"), Node("1", null=True)
        self.rules: dict[str, Node] = {}
        bodies = self._read(self.ebnf)
        changed = True
        while changed:  # which rules may be empty: a least fixed point
            changed = False
            for name, body in bodies.items():
                if not self.rules[name].null and self._nullable(body):
                    self.rules[name].null = changed = True
        for name, body in bodies.items():
            self.rules[name].x = self._build(body)
        self.start = self.rules[self.top]

    def _rule(self, name: str) -> Node:
        if name not in self.rules:
            self.rules[name] = Node("r", name)
        return self.rules[name]

    def _read(self, text: str) -> dict:
        toks = [m.groups() for m in _EBNF.finditer(text)]
        at = 0

        def alt():
            nonlocal at
            parts = [seq()]
            while at < len(toks) and toks[at][2] == "|":
                at += 1
                parts.append(seq())
            return ("a", parts) if len(parts) > 1 else parts[0]

        def seq():
            nonlocal at
            items = []
            while at < len(toks):
                lit, name, sign = toks[at]
                if sign in ("[", "{", "("):
                    at += 1
                    inner = alt()
                    at += 1
                    items.append({"[": ("a", [inner, ("s", [])]), "{": ("*", inner), "(": inner}[sign])
                elif sign:
                    break
                else:
                    at += 1
                    items.append(("t", lit or name) if lit or name.isupper() else ("r", name))
            return ("s", items)

        out = {}
        while at < len(toks):
            name = toks[at][1]
            at += 2
            self._rule(name)
            out[name] = alt()
            at += 1
        return out

    def _nullable(self, b) -> bool:
        kind, x = b
        return kind == "*" or (kind == "a" and any(map(self._nullable, x))) or (kind == "s" and all(map(self._nullable, x))) or (kind == "r" and self.rules[x].null)

    def _build(self, b) -> Node:
        kind, x = b
        if kind == "t":
            return self._intern("t", x)
        if kind == "r":
            return self.rules[x]
        if kind == "*":
            return self.star(self._build(x))
        if kind == "a":
            return self.alt([self._build(p) for p in x])
        out = self.eps
        for p in reversed(x):
            out = self.cat(self._build(p), out)
        return out

    def _intern(self, kind: str, x, y=None, null: bool = False) -> Node:
        key = (kind, x, y)
        got = self.made.get(key)
        if got is None:
            got = self.made[key] = Node(kind, x, y, null)
        return got

    def cat(self, a: Node, b: Node) -> Node:
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if b is self.eps:
            return a
        if a.kind == "c":
            return self.cat(a.x, self.cat(a.y, b))
        return self._intern("c", a, b, a.null and b.null)

    def alt(self, parts) -> Node:
        flat = set()
        for p in parts:
            if p.kind == "a":
                flat |= p.x
            elif p is not self.empty:
                flat.add(p)
        if not flat:
            return self.empty
        if len(flat) == 1:
            return next(iter(flat))
        return self._intern("a", frozenset(flat), None, any(p.null for p in flat))

    def star(self, a: Node) -> Node:
        return self._intern("*", a, None, True)

    def derive(self, n: Node, t: str) -> Node:
        """What may follow t, of what n describes."""
        got = n.d.get(t)
        if got is not None:
            return got
        k = n.kind
        if k == "t":
            out = self.eps if n.x == t or n.x == "ANYTOK" and t not in _BRACKETS else self.empty
        elif k == "c":
            out = self.cat(self.derive(n.x, t), n.y)
            if n.x.null:
                out = self.alt([out, self.derive(n.y, t)])
        elif k == "a":
            out = self.alt([self.derive(p, t) for p in n.x])
        elif k == "*":
            out = self.cat(self.derive(n.x, t), n)
        elif k == "r":
            out = self.derive(n.x, t)
        else:
            out = self.empty
        n.d[t] = out
        return out
