"""Traversals written as text: ``g.V().hasLabel('person').out('knows').values('name').toList()``.

The parser yields the same step records as the fluent API, in every position alike. A script is a list
of statements; ``x = g.addV('p').next()`` binds a name for later ones.
"""

from __future__ import annotations

import re

from weftgraph.functions import geo
from weftgraph.functions.predicates import P, TextP
from weftgraph.operators.textsearch import TextQ
from weftgraph.plans.traversal import MODULATORS, STEPS, Step, Traversal

_TOKEN = re.compile(r"\s*(?:(?P<number>-?\d+\.\d+(?:[eE][-+]?\d+)?[dDfF]?|-?\d+(?P<unit>km|mi|nmi|m)?[lL]?)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<op>[.,()\[\]=;:{}]))|\s*//[^\n]*")
TERMINALS = {"next", "toList", "toSet", "iterate", "hasNext", "explain", "one"}
_P = {"eq", "neq", "lt", "lte", "gt", "gte", "between", "inside", "outside", "within", "without"}
_TEXT = {"containing", "startingWith", "endingWith", "notContaining", "notStartingWith", "notEndingWith", "regex"}


class TraversalSyntaxError(ValueError):
    """The text isn't a traversal."""


class TextParser:
    def __init__(self, text: str, names: dict | None = None):
        self.names, self.tokens, self.at = names or {}, [], 0
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                if text[at:].strip():
                    raise TraversalSyntaxError(f"unexpected {text[at]!r} at {at}")
                break
            if m.lastgroup:
                kind = "number" if m["number"] else m.lastgroup
                self.tokens.append((kind, m[0].strip()))
            at = m.end()

    def peek(self, ahead: int = 0):
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, symbol: str) -> bool:
        if self.peek() == ("op", symbol):
            self.at += 1
            return True
        return False

    def need(self, symbol: str) -> None:
        if not self.take(symbol):
            raise TraversalSyntaxError(f"expected {symbol!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TraversalSyntaxError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def statement(self):
        """(variable or None, steps, terminal or None, its arguments)."""
        variable = None
        if self.peek()[0] == "name" and self.peek(1) == ("op", "="):
            variable = self.name()
            self.at += 1
        if self.name() != "g":
            raise TraversalSyntaxError("a traversal starts with g")
        steps, terminal, args = [], None, ()
        while self.take("."):
            name = self.name()
            got = self.arguments()
            if name in TERMINALS:
                terminal, args = name, got
                break
            self.append(steps, name, got)
        if not steps:
            raise TraversalSyntaxError("a traversal needs a step")
        return variable, tuple(steps), terminal, args

    def append(self, steps: list, name: str, args: tuple) -> None:
        if name in MODULATORS and steps:
            steps[-1] = Step(steps[-1].name, steps[-1].args, [*steps[-1].mods, (name, args)])
        elif name in STEPS:
            steps.append(Step(name, args))
        else:
            raise TraversalSyntaxError(f"unknown step {name}")

    def arguments(self) -> tuple:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.argument())
            self.take(",")
        return tuple(out)

    def anonymous(self, first: str | None = None) -> Traversal:
        steps: list = []
        if first is not None:
            self.append(steps, first, self.arguments())
        while self.take("."):
            self.append(steps, self.name(), self.arguments())
        return Traversal(None, tuple(steps))

    def argument(self):
        kind, value = self.peek()
        if kind == "number":
            self.at += 1
            m = re.fullmatch(r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(km|mi|nmi|m)?[lLdDfF]?", value)
            if m[2]:
                return geo.distance_metres(float(m[1]), m[2])
            return float(m[1]) if re.search(r"[.eE]", m[1]) else int(m[1])
        if kind == "string":
            self.at += 1
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1])
        if self.take("["):
            out = []
            while not self.take("]"):
                out.append(self.argument())
                self.take(",")
            return out
        name = self.name()
        if name in ("true", "false"):
            return name == "true"
        if name == "null":
            return None
        if name == "__":
            return self.anonymous()
        if name in ("P", "TextP", "TextQ", "T", "Order", "Pick", "Scope", "Cardinality", "Column"):
            self.need(".")
            member = self.name()
            if name == "T":
                return f"T.{member}"
            if name in ("Order", "Scope", "Cardinality", "Column"):
                return member
            if name == "Pick":
                return "none"
            return self.predicate(name, member)
        if self.peek() == ("op", "("):
            if name in ("point", "polygon"):
                args = self.arguments()
                return geo.Point(*map(float, args)) if name == "point" else geo.Polygon([p if isinstance(p, geo.Point) else tuple(p) for p in (args[0] if len(args) == 1 else args)])
            if name in _P | _TEXT or name.startswith("geo_"):
                return self.predicate("P", name)
            return self.anonymous(name)
        if name in ("asc", "desc", "shuffle", "incr", "decr", "local", "global", "keys", "values", "single", "none"):
            return name
        if name in self.names:
            return self.names[name]
        raise TraversalSyntaxError(f"unknown name {name}")

    def predicate(self, family: str, member: str):
        args = self.arguments()
        if family == "TextQ":
            return getattr(TextQ, {"matchAll": "match_all", "and": "and_", "or": "or_", "not": "not_"}.get(member, member))(*args)
        p = getattr(TextP, member)(*args) if member in _TEXT else P.not_(*args) if member == "not" else getattr(P, member)(*args)
        while self.peek() == ("op", ".") and self.peek(1)[1] in ("and", "or", "negate"):
            self.at += 1
            joint = self.name()
            rest = self.arguments()
            p = p.negate() if joint == "negate" else p.and_(*rest) if joint == "and" else p.or_(*rest)
        return p


def parse_text(text: str, names: dict | None = None):
    p = TextParser(text, names)
    out = p.statement()
    p.take(";")
    if p.peek()[0] != "end":
        raise TraversalSyntaxError(f"unexpected {p.peek()[1]!r}")
    return out


def run_text(graph, text: str):
    """One traversal: its DataFrame, or what its terminal gives."""
    _, steps, terminal, args = parse_text(text)
    return finish(Traversal(graph, steps), terminal, args)


def finish(t: Traversal, terminal: str | None, args: tuple):
    if any(s.name in ("addV", "addE", "property", "drop") for s in t.steps):
        return t.mutate()
    if terminal is None:
        return t.df()
    return {"next": lambda: t.next(*args), "toList": t.to_list, "toSet": t.to_set, "iterate": t.iterate, "hasNext": t.has_next, "explain": t.explain, "one": t.one}[terminal]()


def run_script(graph, text: str):
    """Statements one by one; (the last graph, the last result). Additions bind their new id."""
    from weftgraph.operators.mutation import next_id

    names: dict = {}
    p = TextParser(text, names)
    result = None
    while p.peek()[0] != "end":
        variable, steps, terminal, args = p.statement()
        t = Traversal(graph, steps)
        added = next((s.name for s in reversed(steps) if s.name in ("addV", "addE")), None)
        if any(s.name in ("addV", "addE", "property", "drop") for s in steps):
            first = next_id(graph, "v" if added == "addV" else "e") if added else None
            graph, counts = t.mutate()
            result = first if added and terminal == "next" else counts
        else:
            result = finish(t, terminal, args)
        if variable:
            names[variable] = result
        while p.take(";"):
            pass
    return graph, result
