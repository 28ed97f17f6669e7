"""Parser of the pattern language: text to a tree of tuples, by recursive descent."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
  | (?P<number>\d+\.\d+(?:[eE][-+]?\d+)?|\d+[eE][-+]?\d+|\d+)
  | (?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")
  | (?P<quoted>`[^`]+`)
  | (?P<name>[A-Za-z_][A-Za-z_0-9]*)
  | (?P<param>\$[A-Za-z_][A-Za-z_0-9]*)
  | (?P<op><=|>=|<>|!=|=~|\|\||\.\.|->|<-|[-+*/%^=<>()\[\]{},.:|;])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "COLLECT"}
CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "UNWIND", "LET", "WITH", "CALL", "RETURN", "CREATE", "SET", "REMOVE", "DELETE", "DETACH", "MERGE", "FOREACH", "UNION", "GROUP", "HAVING", "ORDER", "LIMIT", "SKIP", "OFFSET", "YIELD", "ON"}
UNITS = {"m", "km", "mi", "nmi"}


class GqlError(ValueError):
    """The text isn't a query, or the query isn't valid."""


@dataclass
class Node:
    var: str | None
    labels: list
    props: dict
    where: tuple | None = None


@dataclass
class Edge:
    var: str | None
    labels: list
    props: dict
    direction: str
    where: tuple | None = None
    hops: tuple | None = None  # (least, most), most None if unbounded


@dataclass
class Pattern:
    nodes: list
    edges: list
    name: str | None = None


@dataclass
class Query:
    clauses: list = field(default_factory=list)  # (kind, ...) tuples in order
    branches: list = field(default_factory=list)  # (all, Query) of UNION


class Parser:
    def __init__(self, text: str):
        self.text, self.at, self.tokens = text, 0, []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise GqlError(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], at, m.end()))
            at = m.end()

    # -- tokens -----------------------------------------------------------------------------
    def peek(self, ahead: int = 0):
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "", len(self.text), len(self.text))

    def word(self, *words: str, ahead: int = 0) -> bool:
        kind, value, *_ = self.peek(ahead)
        return kind == "name" and value.upper() in words

    def sign(self, *signs: str, ahead: int = 0) -> bool:
        kind, value, *_ = self.peek(ahead)
        return kind == "op" and value in signs

    def take(self, *wanted: str) -> bool:
        if self.word(*wanted) or self.sign(*wanted):
            self.at += 1
            return True
        return False

    def need(self, *wanted: str) -> str:
        value = self.peek()[1]
        if not self.take(*wanted):
            raise GqlError(f"expected {' or '.join(wanted)} at {self.peek()[2]}, found {value!r}")
        return value

    def name(self) -> str:
        kind, value, at, _ = self.peek()
        if kind not in ("name", "quoted"):
            raise GqlError(f"expected a name at {at}, found {value!r}")
        self.at += 1
        return value.strip("`")

    def integer(self) -> int:
        kind, value, at, _ = self.peek()
        if kind != "number" or not value.isdigit():
            raise GqlError(f"expected a whole number at {at}")
        self.at += 1
        return int(value)

    def done(self) -> bool:
        self.take(";")
        return self.peek()[0] == "end"

    # -- clauses ----------------------------------------------------------------------------
    def query(self, inner: bool = False) -> Query:
        out = self.single(inner)
        while self.take("UNION"):
            out.branches.append((self.take("ALL"), self.single(inner)))
        if not inner and not self.done():
            raise GqlError(f"unexpected {self.peek()[1]!r} at {self.peek()[2]}")
        return out

    def single(self, inner: bool) -> Query:
        q = Query()
        while True:
            if self.peek()[0] == "end" or self.word("UNION") or (inner and self.sign("}")) or self.sign(";"):
                return q
            q.clauses.append(self.clause())

    def clause(self) -> tuple:
        if self.word("WITH") and self.word("PATH", ahead=1):
            self.at += 2
            return ("path", self.name() if self.take("AS") else "path")
        if self.take("MATCH"):
            return ("match", self.patterns())
        if self.take("OPTIONAL"):
            self.need("MATCH")
            patterns = self.patterns()
            return ("optional", patterns, self.expression() if self.take("WHERE") else None)
        if self.take("WHERE"):
            return ("where", self.expression())
        if self.take("UNWIND"):
            e = self.expression()
            self.need("AS")
            return ("unwind", e, self.name())
        if self.take("LET"):
            items = []
            while True:
                n = self.name()
                self.need("=")
                items.append((n, self.expression()))
                if not self.take(","):
                    return ("let", items)
        if self.take("WITH"):
            return ("with", *self.projection(with_where=True))
        if self.take("RETURN"):
            return ("return", *self.projection(with_where=False))
        if self.take("CALL"):
            return self.call()
        if self.take("CREATE"):
            return ("create", self.patterns())
        if self.take("SET"):
            return ("set", self.assignments())
        if self.take("REMOVE"):
            out = []
            while True:
                v = self.name()
                self.need(".")
                out.append((v, self.name()))
                if not self.take(","):
                    return ("remove", out)
        if self.take("DETACH"):
            self.need("DELETE")
            return ("delete", self.names(), True)
        if self.take("DELETE"):
            return ("delete", self.names(), False)
        if self.take("MERGE"):
            pattern, created, matched = self.pattern(), [], []
            while self.take("ON"):
                which = self.need("CREATE", "MATCH").upper()
                self.need("SET")
                (created if which == "CREATE" else matched).extend(self.assignments())
            return ("merge", pattern, created, matched)
        if self.take("FOREACH"):
            self.need("(")
            v = self.name()
            self.need("IN")
            e = self.expression()
            self.need("|")
            inner = []
            while not self.sign(")"):
                inner.append(self.clause())
            self.need(")")
            return ("foreach", v, e, inner)
        raise GqlError(f"unexpected {self.peek()[1]!r} at {self.peek()[2]}")

    def names(self) -> list[str]:
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        return out

    def assignments(self) -> list:
        out = []
        while True:
            v = self.name()
            self.need(".")
            k = self.name()
            self.need("=")
            out.append((v, k, self.expression()))
            if not self.take(","):
                return out

    def call(self) -> tuple:
        if self.take("{"):
            imports = None
            if self.word("WITH") and not self.word("PATH", ahead=1):
                mark = self.at
                self.at += 1
                imports = self.names()
                if self.word("WHERE", "ORDER", "LIMIT") or self.sign("."):
                    self.at, imports = mark, None
            q = self.query(inner=True)
            self.need("}")
            return ("call", imports, q)
        name = self.name()
        while self.take("."):
            name = self.name()
        self.need("(")
        args = []
        while not self.sign(")"):
            args.append(self.expression())
            self.take(",")
        self.need(")")
        fields = None
        if self.take("YIELD"):
            fields = []
            while True:
                f = self.name()
                fields.append((f, self.name() if self.take("AS") else f))
                if not self.take(","):
                    break
        return ("procedure", name, args, fields)

    def projection(self, with_where: bool):
        distinct = self.take("DISTINCT")
        items = []
        while True:
            start = self.peek()[2]
            if self.sign("*") and not items:
                self.at += 1
                items.append((("star",), "*"))
            else:
                e = self.expression()
                text = self.text[start : self.tokens[self.at - 1][3]]
                items.append((e, self.name() if self.take("AS") else text))
            if not self.take(","):
                break
        extra: dict = {"group": None, "having": None, "where": None, "order": [], "skip": 0, "limit": None}
        while True:
            if self.word("GROUP"):
                self.at += 1
                self.need("BY")
                extra["group"] = self.list_of()
            elif self.take("HAVING"):
                extra["having"] = self.expression()
            elif with_where and self.take("WHERE"):
                extra["where"] = self.expression()
            elif self.word("ORDER"):
                self.at += 1
                self.need("BY")
                while True:
                    e = self.expression()
                    down = self.take("DESC", "DESCENDING")
                    if not down:
                        self.take("ASC", "ASCENDING")
                    extra["order"].append((e, down))
                    if not self.take(","):
                        break
            elif self.take("LIMIT"):
                extra["limit"] = self.integer()
            elif self.take("SKIP", "OFFSET"):
                extra["skip"] = self.integer()
            else:
                return distinct, items, extra

    def list_of(self) -> list:
        out = [self.expression()]
        while self.take(","):
            out.append(self.expression())
        return out

    # -- patterns ---------------------------------------------------------------------------
    def patterns(self) -> list[Pattern]:
        out = [self.pattern()]
        while self.take(","):
            out.append(self.pattern())
        return out

    def pattern(self) -> Pattern:
        name = None
        if self.peek()[0] == "name" and self.sign("=", ahead=1):
            name = self.name()
            self.at += 1
        nodes, edges = [self.node()], []
        while self.sign("-", "<-", "<", "->"):
            edges.append(self.edge())
            nodes.append(self.node())
        return Pattern(nodes, edges, name)

    def inside(self):
        var = self.name() if self.peek()[0] in ("name", "quoted") and not self.word("WHERE") else None
        labels = []
        if self.take(":"):
            labels.append(self.name())
            while self.take("|", ":"):
                self.take(":")
                labels.append(self.name())
        return var, labels

    def map_literal(self) -> dict:
        out = {}
        self.need("{")
        while not self.sign("}"):
            k = self.name()
            self.need(":")
            out[k] = self.expression()
            self.take(",")
        self.need("}")
        return out

    def node(self) -> Node:
        self.need("(")
        var, labels = self.inside()
        props = self.map_literal() if self.sign("{") else {}
        where = self.expression() if self.take("WHERE") else None
        self.need(")")
        return Node(var, labels, props, where)

    def edge(self) -> Edge:
        left = self.take("<-")
        if not left:
            if self.take("->"):
                return Edge(None, [], {}, "out")
            self.need("-")
        out = Edge(None, [], {}, "both")
        if self.take("["):
            out.var, out.labels = self.inside()
            if self.take("*"):
                out.hops = (0, None)
                if self.peek()[0] == "number":
                    n = self.integer()
                    out.hops = (n, n)
                    if self.take(".."):
                        out.hops = (n, self.integer() if self.peek()[0] == "number" else None)
                elif self.take(".."):
                    out.hops = (0, self.integer())
            if self.sign("{"):
                out.props = self.map_literal()
            if self.take("WHERE"):
                out.where = self.expression()
            self.need("]")
            right = self.take("->")
            if not right:
                self.need("-")
        else:
            right = self.take("->") if left else not self.sign("(") and (self.take(">") or self.take("->"))
            if not right:
                self.take("-")
        out.direction = "in" if left and not right else "out" if right and not left else "both"
        return out

    # -- expressions ------------------------------------------------------------------------
    def expression(self) -> tuple:
        left = self.conjunction()
        while self.take("OR"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.negation()
        while self.take("AND"):
            left = ("and", left, self.negation())
        return left

    def negation(self) -> tuple:
        if self.word("NOT") and not self.word("IN", ahead=1):
            self.at += 1
            return ("not", self.negation())
        return self.comparison()

    def comparison(self) -> tuple:
        left = self.joined()
        while True:
            if self.sign("=", "<>", "!=", "<", "<=", ">", ">=", "=~"):
                op = self.peek()[1]
                self.at += 1
                left = ("compare", {"!=": "<>"}.get(op, op), left, self.joined())
            elif self.take("CONTAINS"):
                left = ("compare", "contains", left, self.joined())
            elif self.word("STARTS", "ENDS"):
                op = self.peek()[1].lower()
                self.at += 1
                self.need("WITH")
                left = ("compare", op, left, self.joined())
            elif self.take("IN"):
                left = ("in", left, self.joined())
            elif self.word("NOT") and self.word("IN", ahead=1):
                self.at += 2
                left = ("not", ("in", left, self.joined()))
            elif self.take("IS"):
                no = self.take("NOT")
                self.need("NULL")
                left = ("not", ("null?", left)) if no else ("null?", left)
            else:
                return left

    def joined(self) -> tuple:
        left = self.sum()
        while self.take("||"):
            left = ("join", left, self.sum())
        return left

    def sum(self) -> tuple:
        left = self.product()
        while self.sign("+", "-"):
            op = self.peek()[1]
            self.at += 1
            left = ("math", op, left, self.product())
        return left

    def product(self) -> tuple:
        left = self.power()
        while self.sign("*", "/", "%"):
            op = self.peek()[1]
            self.at += 1
            left = ("math", op, left, self.power())
        return left

    def power(self) -> tuple:
        left = self.unary()
        if self.take("^"):
            return ("math", "^", left, self.power())
        return left

    def unary(self) -> tuple:
        if self.take("-"):
            return ("minus", self.unary())
        return self.postfix()

    def postfix(self) -> tuple:
        e = self.atom()
        while True:
            if self.take("["):
                if self.take(".."):
                    e = ("slice", e, None, self.expression())
                else:
                    a = self.expression()
                    if self.take(".."):
                        e = ("slice", e, a, None if self.sign("]") else self.expression())
                    else:
                        e = ("item", e, a)
                self.need("]")
            elif self.sign(".") and e[0] != "number":
                self.at += 1
                e = ("prop", e, self.name())
            else:
                return e

    def atom(self) -> tuple:
        kind, value, at, end = self.peek()
        if kind == "number":
            self.at += 1
            following = self.peek()
            if following[0] == "name" and following[1] in UNITS and following[2] == end:
                self.at += 1
                return ("distance", float(value), following[1])
            return ("literal", float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "string":
            self.at += 1
            body = value[1:-1].replace("''", "'") if value[0] == "'" else value[1:-1]
            return ("literal", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body))
        if kind == "param":
            self.at += 1
            return ("param", value[1:])
        if self.sign("{"):
            return ("map", self.map_literal())
        if self.sign("["):
            return self.list()
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.word("TRUE", "FALSE"):
            self.at += 1
            return ("literal", value.upper() == "TRUE")
        if self.take("NULL"):
            return ("literal", None)
        if self.take("CASE"):
            arms, other = [], ("literal", None)
            while self.take("WHEN"):
                test = self.expression()
                self.need("THEN")
                arms.append((test, self.expression()))
            if self.take("ELSE"):
                other = self.expression()
            self.need("END")
            return ("case", arms, other)
        if self.word("EXISTS") and self.sign("{", ahead=1):
            self.at += 2
            self.take("MATCH")
            pattern = self.pattern()
            where = self.expression() if self.take("WHERE") else None
            self.need("}")
            return ("exists", pattern, where)
        if self.word("ALL", "ANY", "NONE", "SINGLE") and self.sign("(", ahead=1):
            which = value.upper()
            self.at += 2
            v = self.name()
            self.need("IN")
            e = self.expression()
            self.need("WHERE")
            test = self.expression()
            self.need(")")
            return ("quantifier", which, v, e, test)
        if self.word("REDUCE") and self.sign("(", ahead=1):
            self.at += 2
            acc = self.name()
            self.need("=")
            init = self.expression()
            self.need(",")
            v = self.name()
            self.need("IN")
            e = self.expression()
            self.need("|")
            body = self.expression()
            self.need(")")
            return ("reduce", acc, init, v, e, body)
        if kind in ("name", "quoted"):
            self.at += 1
            name = value.strip("`")
            while self.sign(".") and self.peek(1)[0] == "name" and self.sign("(", ahead=2) and name.lower() == "point":
                self.at += 1
                name = f"{name}.{self.name()}"
            if self.sign("(") and kind == "name":
                self.at += 1
                distinct = self.take("DISTINCT")
                args = []
                if self.sign("*"):
                    self.at += 1
                    args = [("star",)]
                while not self.sign(")"):
                    args.append(self.expression())
                    self.take(",")
                self.need(")")
                upper = name.upper()
                return ("aggregate", upper, distinct, args) if upper in AGGREGATES else ("call", upper, args)
            return ("var", name)
        raise GqlError(f"unexpected {value!r} at {at}")

    def list(self) -> tuple:
        self.need("[")
        if self.peek()[0] in ("name", "quoted") and self.word("IN", ahead=1):
            v = self.name()
            self.at += 1
            e = self.expression()
            test = self.expression() if self.take("WHERE") else None
            body = self.expression() if self.take("|") else ("var", v)
            self.need("]")
            return ("comprehension", v, e, test, body)
        if self.sign("("):
            mark = self.at
            try:
                pattern = self.pattern()
                if pattern.edges:
                    where = self.expression() if self.take("WHERE") else None
                    self.need("|")
                    body = self.expression()
                    self.need("]")
                    return ("pattern list", pattern, where, body)
            except GqlError:
                pass
            self.at = mark
        out = []
        while not self.sign("]"):
            out.append(self.expression())
            self.take(",")
        self.need("]")
        return ("list", out)


def parse(text: str) -> Query:
    return Parser(text).query()


def walk(e):
    """Every node of an expression tree."""
    yield e
    if isinstance(e, tuple):
        for x in e:
            if isinstance(x, tuple):
                yield from walk(x)
            elif isinstance(x, list):
                for y in x:
                    if isinstance(y, tuple):
                        yield from walk(y)
            elif isinstance(x, dict):
                for y in x.values():
                    yield from walk(y)


def aggregates(e) -> bool:
    return any(isinstance(x, tuple) and x and x[0] == "aggregate" for x in walk(e))
