"""A recursive-descent parser of the read-only openCypher subset. Expressions and clauses are plain tuples."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class CypherError(ValueError):
    """The text is not in the subset."""


_TOKEN = re.compile(
    r"\s+|//[^\n]*|/\*.*?\*/|(?P<num>0[xX][0-9a-fA-F]+|0o[0-7]+|\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?|\d+)|(?P<str>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\")|(?P<id>[A-Za-z_]\w*|`[^`]+`)|(?P<par>\$\w+)|(?P<op><>|<=|>=|=~|\.\.|<-|->|[-+*/%^=<>()\[\]{}.,:|;])",
    re.S,
)
WRITES = {"create", "merge", "set", "remove", "delete", "detach"}
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "percentilecont", "percentiledisc", "stdev", "stdevp"}


@dataclass
class NodePattern:
    var: str | None
    labels: list[str]
    props: dict


@dataclass
class EdgePattern:
    var: str | None
    types: list[str]
    props: dict
    direction: str
    low: int | None = None
    high: int | None = None

    @property
    def variable_length(self) -> bool:
        return self.low is not None


@dataclass
class Path:
    var: str | None
    nodes: list[NodePattern]
    edges: list[EdgePattern]


@dataclass
class Item:
    expr: tuple
    name: str


@dataclass
class Clause:
    kind: str
    paths: list[Path] = field(default_factory=list)
    where: tuple | None = None
    items: list[Item] = field(default_factory=list)
    star: bool = False
    distinct: bool = False
    order: list[tuple[tuple, bool]] = field(default_factory=list)
    skip: tuple | None = None
    limit: tuple | None = None
    expr: tuple | None = None
    var: str | None = None
    all: bool = False


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CypherError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return [*out, ("end", "")]


def string_value(raw: str) -> str:
    q, body = raw[0], raw[1:-1].replace(raw[0] * 2, raw[0])
    body = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), body)
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(m[1], m[1]), body)


class Parser:
    def __init__(self, text: str) -> None:
        self.t, self.i = tokens(text), 0
        self.anonymous = 0

    def word(self, k: int = 0) -> str:
        kind, v = self.t[min(self.i + k, len(self.t) - 1)]
        return v.lower() if kind in ("id", "op") else ""

    def take(self, *words: str) -> bool:
        if all(self.word(k) == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise CypherError(f"expected {word!r}, found {self.t[self.i][1]!r}")

    def name(self) -> str:
        kind, v = self.t[self.i]
        if kind != "id":
            raise CypherError(f"expected a name, found {v!r}")
        self.i += 1
        return v.strip("`")

    # clauses
    def statements(self) -> list[list[Clause]]:
        out = []
        while self.t[self.i][0] != "end":
            if self.take(";"):
                continue
            out.append(self.statement())
        if not out:
            raise CypherError("empty query")
        return out

    def statement(self) -> list[Clause]:
        out = []
        while (w := self.word()) not in ("", ";"):
            if w in WRITES:
                raise NotImplementedError(f"{w.upper()} is not supported: graphs are read-only")
            if self.take("optional", "match"):
                out.append(self.match("optional"))
            elif self.take("match"):
                out.append(self.match("match"))
            elif self.take("unwind"):
                e = self.expr()
                self.need("as")
                out.append(Clause("unwind", expr=e, var=self.name()))
            elif self.take("with"):
                out.append(self.projection("with"))
            elif self.take("return"):
                out.append(self.projection("return"))
            elif self.take("union"):
                out.append(Clause("union", all=self.take("all")))
            else:
                raise CypherError(f"unexpected {self.t[self.i][1]!r}")
        if self.t[self.i][0] not in ("end", "op"):
            raise CypherError(f"unexpected {self.t[self.i][1]!r}")
        if not out or out[-1].kind != "return":
            raise CypherError("a query must end with RETURN")
        return out

    def match(self, kind: str) -> Clause:
        c = Clause(kind, paths=[self.path()])
        while self.take(","):
            c.paths.append(self.path())
        if self.take("where"):
            c.where = self.expr()
        return c

    def projection(self, kind: str) -> Clause:
        c = Clause(kind, distinct=self.take("distinct"))
        if self.take("*"):
            c.star = True
            more = self.take(",")
        else:
            more = True
        while more:
            e = self.expr()
            c.items.append(Item(e, self.name() if self.take("as") else render(e)))
            more = self.take(",")
        if kind == "with" and self.take("where"):
            c.where = self.expr()
        if self.take("order", "by"):
            while True:
                e = self.expr()
                down = self.word() in ("desc", "descending")
                if self.word() in ("asc", "ascending", "desc", "descending"):
                    self.i += 1
                c.order.append((e, down))
                if not self.take(","):
                    break
        if self.take("skip"):
            c.skip = self.expr()
        if self.take("limit"):
            c.limit = self.expr()
        if kind == "with" and c.where is None and self.take("where"):
            c.where = self.expr()
        return c

    # patterns
    def path(self) -> Path:
        var = None
        if self.t[self.i][0] == "id" and self.word(1) == "=":
            var = self.name()
            self.need("=")
        nodes, edges = [self.node()], []
        while self.word() in ("-", "<-", "->", "<"):
            edges.append(self.edge())
            nodes.append(self.node())
        return Path(var, nodes, edges)

    def props(self) -> dict:
        out: dict = {}
        if self.take("{"):
            while not self.take("}"):
                k = self.name()
                self.need(":")
                out[k] = self.expr()
                self.take(",")
        return out

    def node(self) -> NodePattern:
        self.need("(")
        var = self.name() if self.t[self.i][0] == "id" else None
        labels = []
        while self.take(":"):
            labels.append(self.name())
        props = self.props()
        self.need(")")
        return NodePattern(var, labels, props)

    def edge(self) -> EdgePattern:
        left = self.take("<-") or (self.take("<", "-"))
        if not left and not self.take("-") and not self.take("->"):
            raise CypherError("expected a relationship")
        if not left and self.t[self.i - 1][1] == "->":
            return EdgePattern(None, [], {}, "out")
        e = EdgePattern(None, [], {}, "both")
        if self.take("["):
            e.var = self.name() if self.t[self.i][0] == "id" else None
            if self.take(":"):
                e.types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    e.types.append(self.name())
            if self.take("*"):
                e.low, e.high = 1, 10
                if self.t[self.i][0] == "num" and "." not in self.t[self.i][1]:
                    e.low = e.high = self.integer()
                    if self.take(".."):
                        e.high = self.integer() if self.t[self.i][0] == "num" else max(10, e.low)
                elif self.take(".."):
                    e.high = self.integer() if self.t[self.i][0] == "num" else 10
            e.props = self.props()
            self.need("]")
        right = self.take("->")
        if not right and not self.take("-"):
            raise CypherError("unfinished relationship")
        e.direction = "both" if left == right else "in" if left else "out"
        return e

    def integer(self) -> int:
        v = self.t[self.i][1]
        self.i += 1
        return int(v)

    # expressions, loosest first
    def expr(self) -> tuple:
        return self.binary(("or",), lambda: self.binary(("xor",), lambda: self.binary(("and",), self.negation)))

    def binary(self, words: tuple, below) -> tuple:
        e = below()
        while self.word() in words:
            op = self.word()
            self.i += 1
            e = ("op", op, e, below())
        return e

    def negation(self) -> tuple:
        if self.take("not"):
            return ("not", self.negation())
        return self.comparison()

    def comparison(self) -> tuple:
        e, parts = self.predicate(), []
        while self.word() in ("=", "<>", "<", ">", "<=", ">=", "=~"):
            op = self.word()
            self.i += 1
            right = self.predicate()
            parts.append(("op", op, e, right))
            e = right
        if not parts:
            return e
        out = parts[0]
        for p in parts[1:]:
            out = ("op", "and", out, p)
        return out

    def predicate(self) -> tuple:
        e = self.additive()
        while True:
            inverted = self.word() == "not" and self.word(1) in ("starts", "ends", "contains", "in")
            k = 1 if inverted else 0
            w = self.word(k)
            if w in ("starts", "ends") and self.word(k + 1) == "with":
                self.i += k + 2
                e = ("op", w, e, self.additive())
            elif w in ("contains", "in"):
                self.i += k + 1
                e = ("op", w, e, self.additive())
            elif w == "is":
                self.i += 1
                no = self.take("not")
                self.need("null")
                e = ("isnull", e, no)
            else:
                return e
            if inverted:
                e = ("not", e)

    def additive(self) -> tuple:
        return self.binary(("+", "-"), lambda: self.binary(("*", "/", "%"), self.power))

    def power(self) -> tuple:
        e = self.unary()
        if self.take("^"):
            return ("op", "^", e, self.power())
        return e

    def unary(self) -> tuple:
        if self.take("-"):
            return ("neg", self.unary())
        if self.take("+"):
            return self.unary()
        return self.postfix()

    def postfix(self) -> tuple:
        e = self.atom()
        while True:
            if self.word() == "." and self.t[self.i + 1][0] == "id":
                self.i += 1
                e = ("prop", e, self.name())
            elif self.take("["):
                low = None if self.word() == ".." else self.expr()
                if self.take(".."):
                    high = None if self.word() == "]" else self.expr()
                    e = ("slice", e, low, high)
                else:
                    e = ("index", e, low)
                self.need("]")
            else:
                return e

    def atom(self) -> tuple:
        kind, v = self.t[self.i]
        w = self.word()
        if kind == "num":
            self.i += 1
            if re.fullmatch(r"0[xX].*|0o.*|\d+", v):
                return ("lit", int(v.replace("0o", ""), 8) if v.startswith("0o") else int(v, 0 if v[:2].lower() == "0x" else 10))
            return ("lit", float(v))
        if kind == "str":
            self.i += 1
            return ("lit", string_value(v))
        if kind == "par":
            self.i += 1
            return ("param", v[1:])
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("["):
            if self.t[self.i][0] == "id" and self.word(1) == "in":
                var = self.name()
                self.need("in")
                source = self.expr()
                where = self.expr() if self.take("where") else None
                made = self.expr() if self.take("|") else None
                self.need("]")
                return ("comp", var, source, where, made)
            items = []
            while not self.take("]"):
                items.append(self.expr())
                self.take(",")
            return ("list", items)
        if w == "{":
            return ("map", self.props())
        if kind != "id":
            raise CypherError(f"unexpected {v!r}")
        if w in ("true", "false", "null"):
            self.i += 1
            return ("lit", {"true": True, "false": False, "null": None}[w])
        if w == "case":
            self.i += 1
            subject = None if self.word() == "when" else self.expr()
            arms = []
            while self.take("when"):
                c = self.expr()
                self.need("then")
                arms.append((c, self.expr()))
            other = self.expr() if self.take("else") else ("lit", None)
            self.need("end")
            return ("case", subject, arms, other)
        if self.word(1) == "(":
            name = self.name()
            self.need("(")
            low = name.lower()
            if low in ("any", "all", "none", "single") and self.t[self.i][0] == "id" and self.word(1) == "in":
                var = self.name()
                self.need("in")
                source = self.expr()
                self.need("where")
                where = self.expr()
                self.need(")")
                return ("quant", low, var, source, where)
            if self.take("*"):
                self.need(")")
                return ("call", low, [], False, name)
            distinct, args = self.take("distinct"), []
            while not self.take(")"):
                args.append(self.expr())
                self.take(",")
            return ("call", low, args, distinct, name)
        return ("var", self.name())


def parse(text: str) -> list[list[Clause]]:
    return Parser(text).statements()


def render(e: tuple) -> str:
    """The text that names a column without an alias."""
    k = e[0]
    if k == "lit":
        return "null" if e[1] is None else str(e[1]).lower() if isinstance(e[1], bool) else repr(e[1]) if isinstance(e[1], str) else str(e[1])
    if k == "var":
        return e[1]
    if k == "param":
        return "$" + e[1]
    if k == "prop":
        return f"{render(e[1])}.{e[2]}"
    if k == "op":
        word = {"starts": "STARTS WITH", "ends": "ENDS WITH"}.get(e[1], e[1].upper())
        return f"{render(e[2])} {word} {render(e[3])}"
    if k == "not":
        return f"NOT {render(e[1])}"
    if k == "neg":
        return f"-{render(e[1])}"
    if k == "isnull":
        return f"{render(e[1])} IS {'NOT ' if e[2] else ''}NULL"
    if k == "call":
        return f"{e[4]}({'DISTINCT ' if e[3] else ''}{', '.join(map(render, e[2])) if e[2] else '*' if e[1] == 'count' else ''})"
    if k == "list":
        return f"[{', '.join(map(render, e[1]))}]"
    if k == "index":
        return f"{render(e[1])}[{render(e[2])}]"
    if k == "slice":
        return f"{render(e[1])}[{render(e[2]) if e[2] else ''}..{render(e[3]) if e[3] else ''}]"
    return k


def has_aggregate(e) -> bool:
    if isinstance(e, tuple) and e and e[0] == "call" and e[1] in AGGREGATES:
        return True
    return isinstance(e, (tuple, list)) and any(has_aggregate(x) for x in e) or isinstance(e, dict) and any(has_aggregate(x) for x in e.values())


def used(e, out: dict[str, set[str] | None]) -> None:
    """Properties that an expression reads of each variable; None: all of them."""
    if isinstance(e, tuple) and e:
        if e[0] == "prop" and e[1][0] == "var":
            if out.get(e[1][1], set()) is not None:
                out.setdefault(e[1][1], set()).add(e[2])
            return
        if e[0] == "call" and e[1] in ("id", "labels", "type", "graphid", "elementid", "qualifiedid", "count", "startnode", "endnode", "exists", "length") and len(e[2]) == 1 and e[2][0][0] == "var":
            out.setdefault(e[2][0][1], set())
            return
        if e[0] == "var":
            out[e[1]] = None
            return
    if isinstance(e, (tuple, list)):
        for x in e:
            used(x, out)
    elif isinstance(e, dict):
        for x in e.values():
            used(x, out)
