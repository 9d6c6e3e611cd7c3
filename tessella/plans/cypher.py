"""Cypher over nodes (id, label, properties..) and edges (src, dst, rel, properties..), compiled to joins.

    MATCH (o:order)-[:PLACED_BY]->(c:customer)-[:LOCATED_IN]->(n) WHERE o.value > 300000 AND c.id STARTS WITH 'customer:1'
    RETURN n.id AS nation, count(*) AS orders ORDER BY orders DESC, nation LIMIT 5

Reading: MATCH and OPTIONAL MATCH, each with its own WHERE, of comma-separated
patterns with property maps, alternative labels and types, either or no
direction, relationship variables, `*m..n` and `((a)-[]->(b)){m,n}`; WITH,
UNWIND, CALL {subquery}, CALL procedure YIELD, RETURN [DISTINCT] with implicit
grouping, ORDER BY, SKIP, LIMIT, UNION [ALL]. Writing: CREATE, MERGE, SET,
REMOVE, [DETACH] DELETE give a new Graph. Relationships of one MATCH differ
pairwise; an edge is known by (src, dst, rel).

The text is parsed into Spark SQL expressions; only names in scope, literals,
known functions and operators reach the plan. A bound start of a pattern seeds
it, so it isn't expanded from all nodes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import held


class CypherFault(ValueError):
    """The query can't be read."""


_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+(?:\.(?!\.)\d+)?)|([A-Za-z_]\w*|`[^`]+`)|(<=|>=|<>|=~|\.\.|[-=<>(){}\[\],.:;*+/|%^$]))")
_AGGREGATES = {"count": "count", "sum": "sum", "avg": "avg", "min": "min", "max": "max", "collect": "collect_list", "stdev": "stddev_samp", "stdevp": "stddev_pop"}
_FUNCTIONS = {
    "toupper": "upper", "tolower": "lower", "abs": "abs", "coalesce": "coalesce", "floor": "floor", "ceil": "ceil", "round": "round", "sqrt": "sqrt", "sign": "sign", "exp": "exp",
    "log": "ln", "trim": "trim", "replace": "replace", "split": "split", "left": "left", "right": "right", "reverse": "reverse", "tostring": "string", "tointeger": "bigint",
    "tofloat": "double", "range": "sequence", "nullif": "nullif",
}
_FOLDS = {"apoc.coll.sum": "aggregate({0}, CAST(0 AS DOUBLE), (a, x) -> a + x)", "apoc.coll.max": "array_max({0})", "apoc.coll.min": "array_min({0})", "apoc.coll.avg": "aggregate({0}, CAST(0 AS DOUBLE), (a, x) -> a + x) / nullif(size({0}), 0)"}


@dataclass
class NodePattern:
    name: str
    labels: list[str]
    props: dict[str, str]


@dataclass
class EdgePattern:
    name: str
    kinds: list[str]
    props: dict[str, str]
    direction: int  # 1 along the text, -1 against it, 0 either
    span: tuple[int, int | None] | None = None
    inner: list | None = None


@dataclass
class Scope:
    """Variables by kind: node, edge, edges (a list of them) or value."""

    kinds: dict[str, str] = field(default_factory=dict)


class Reader:
    """Tokens and the expression grammar; expressions become Spark SQL."""

    def __init__(self, text: str, params: dict | None = None):
        self.tokens, self.at, self.params, self.fresh = [], 0, params or {}, 0
        at, text = 0, text.strip().rstrip(";").strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise CypherFault(f"unexpected {text[at : at + 20]!r}")
            self.tokens.append(m[0].strip())
            at = m.end()
        self.scope = Scope()
        self.aggregate = False

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ""

    def word(self, k: int = 0) -> str:
        return self.peek(k).upper()

    def take(self, wanted: str | None = None) -> str:
        t = self.peek()
        if not t or wanted and t.upper() != wanted:
            raise CypherFault(f"expected {wanted or 'more'}, found {t or 'the end'!r}")
        self.at += 1
        return t

    def took(self, *wanted: str) -> bool:
        if all(self.word(k) == w for k, w in enumerate(wanted)):
            self.at += len(wanted)
            return True
        return False

    def name(self) -> str:
        t = self.take()
        if not re.match(r"[A-Za-z_`]", t):
            raise CypherFault(f"not a name: {t!r}")
        return t.strip("`")

    def number(self) -> int:
        t = self.take()
        if not t.isdigit():
            raise CypherFault(f"not a number: {t!r}")
        return int(t)

    # --- expressions
    def expression(self) -> str:
        left = self.conjunction()
        while self.word() in ("OR", "XOR"):
            op = self.take().upper()
            right = self.conjunction()
            left = f"({left} OR {right})" if op == "OR" else f"(({left}) <> ({right}))"
        return left

    def conjunction(self) -> str:
        left = self.negation()
        while self.took("AND"):
            left = f"({left} AND {self.negation()})"
        return left

    def negation(self) -> str:
        return f"(NOT {self.negation()})" if self.took("NOT") else self.comparison()

    def comparison(self) -> str:
        left, out = self.sum(), None
        while True:
            t = self.peek()
            if t in ("=", "<>", "<", "<=", ">", ">="):
                self.take()
                right = self.sum()
                new = f"({left} {t} {right})"
                out, left = (f"({out} AND {new})" if out else new), right
                continue
            if t == "=~":
                self.take()
                new = f"rlike({left}, concat('^(?:', {self.sum()}, ')$'))"
            elif self.took("STARTS", "WITH"):
                new = f"startswith({left}, {self.sum()})"
            elif self.took("ENDS", "WITH"):
                new = f"endswith({left}, {self.sum()})"
            elif self.took("CONTAINS"):
                new = f"contains({left}, {self.sum()})"
            elif self.took("IS", "NOT", "NULL"):
                new = f"({left} IS NOT NULL)"
            elif self.took("IS", "NULL"):
                new = f"({left} IS NULL)"
            elif self.took("IN"):
                new = f"array_contains({self.sum()}, {left})"
            else:
                return out or left
            out = left = new

    def sum(self) -> str:
        left = self.product()
        while self.peek() in ("+", "-"):
            op, right = self.take(), self.product()
            text = left.startswith("'") or right.startswith("'") or left.startswith("concat(")
            left = f"concat({left}, {right})" if op == "+" and text else f"({left} {op} {right})"
        return left

    def product(self) -> str:
        left = self.power()
        while self.peek() in ("*", "/", "%"):
            left = f"({left} {self.take()} {self.power()})"
        return left

    def power(self) -> str:
        left = self.unary()
        while self.peek() == "^":
            self.take()
            left = f"power({left}, {self.unary()})"
        return left

    def unary(self) -> str:
        if self.peek() == "-":
            self.take()
            return f"(- {self.unary()})"
        out = self.atom()
        while self.peek() == "[":
            self.take()
            low = None if self.peek() == ".." else self.expression()
            if self.peek() == "..":
                self.take()
                high = None if self.peek() == "]" else self.expression()
                out = f"slice({out}, {low or 0} + 1, {f'greatest({high} - {low or 0}, 0)' if high else f'size({out})'})"
            else:
                out = f"get({out}, CAST(CASE WHEN {low} < 0 THEN size({out}) + {low} ELSE {low} END AS INT))"
            self.take("]")
        return out

    def atom(self) -> str:
        t, upper = self.peek(), self.word()
        if t == "(":
            self.take()
            out = self.expression()
            self.take(")")
            return f"({out})"
        if t[:1] in "'\"" and t:
            self.take()
            return "'" + re.sub(r"\\(.)", r"\1", t[1:-1]).replace("\\", "\\\\").replace("'", "\\'") + "'"
        if t[:1].isdigit():
            return f"{self.take()}D" if "." in t else self.take()
        if t == "$":
            self.take()
            return literal(self.params[self.name()])
        if t == "[":
            return self.list()
        if upper in ("TRUE", "FALSE", "NULL"):
            return self.take().upper()
        if upper == "CASE":
            return self.case()
        if upper == "COUNT" and self.peek(1) == "(" and self.peek(2) == "*":
            self.at += 4
            self.aggregate = True
            return "count(1)"
        name = self.name()
        while self.peek() == "." and self.peek(2) in (".", "(") and name not in self.scope.kinds:
            self.take()
            name += "." + self.name()
        if self.peek() == "(":
            return self.call(name)
        return self.variable(name)

    def list(self) -> str:
        self.take("[")
        if self.word(1) == "IN":
            name = self.name()
            self.take()
            source = self.expression()
            before, self.scope.kinds[name] = self.scope.kinds.get(name), "lambda"
            if self.took("WHERE"):
                source = f"filter({source}, {name} -> {self.expression()})"
            if self.peek() == "|":
                self.take()
                source = f"transform({source}, {name} -> {self.expression()})"
            self.scope.kinds.pop(name)
            if before:
                self.scope.kinds[name] = before
            self.take("]")
            return source
        items = []
        while self.peek() != "]":
            items.append(self.expression())
            if self.peek() == ",":
                self.take()
        self.take("]")
        return f"array({', '.join(items)})"

    def case(self) -> str:
        out = self.take().upper()
        if self.word() != "WHEN":
            out += " " + self.expression()
        while self.took("WHEN"):
            out += f" WHEN {self.expression()}"
            self.take("THEN")
            out += f" THEN {self.expression()}"
        if self.took("ELSE"):
            out += f" ELSE {self.expression()}"
        self.take("END")
        return out + " END"

    def call(self, name: str) -> str:
        self.take("(")
        low = name.lower()
        distinct = self.took("DISTINCT")
        bare = self.peek().strip("`") if self.peek(1) == ")" else ""
        kind = self.scope.kinds.get(bare)
        args = []
        while self.peek() != ")":
            args.append(self.expression())
            if self.peek() == ",":
                self.take()
        self.take(")")
        if low in _AGGREGATES:
            self.aggregate = True
            return f"{'collect_set' if low == 'collect' and distinct else _AGGREGATES[low]}({'DISTINCT ' if distinct and low != 'collect' else ''}{', '.join(args)})"
        if low in _FOLDS:
            return _FOLDS[low].format(*args)
        if low == "labels" and kind == "node":
            return f"array(`{bare}`.`label`)"
        if low == "type" and kind == "edge":
            return f"`{bare}`.`rel`"
        if low == "id" and kind == "node":
            return f"`{bare}`.`id`"
        if low in ("startnode", "endnode") and kind == "edge":
            return f"`{bare}`.`{'src' if low == 'startnode' else 'dst'}`"
        if low in ("length", "size"):
            return f"size({args[0]})" if kind == "edges" or args[0].startswith(("array(", "filter(", "transform(", "split(", "collect", "slice(", "sequence(")) or kind == "list" else f"length({args[0]})"
        if low in ("head", "last"):
            return f"try_element_at({args[0]}, {1 if low == 'head' else -1})"
        if low == "exists":
            return f"({args[0]} IS NOT NULL)"
        if low == "substring":
            return f"substring({args[0]}, {args[1]} + 1{f', {args[2]}' if len(args) > 2 else ''})"
        if low not in _FUNCTIONS:
            raise CypherFault(f"unknown function {name}")
        return f"{_FUNCTIONS[low]}({', '.join(args)})"

    def variable(self, name: str) -> str:
        kind = self.scope.kinds.get(name)
        if kind is None:
            raise CypherFault(f"unknown name {name}")
        if kind == "lambda":
            return f"{name}.`{self._property()}`" if self.peek() == "." else name
        if self.peek() == "." and kind in ("node", "edge"):
            return f"`{name}`.`{self._property()}`"
        return f"`{name}`.`id`" if kind == "node" else f"`{name}`"

    def _property(self) -> str:
        self.take(".")
        return self.name()

    # --- patterns
    def properties(self) -> dict[str, str]:
        out = {}
        if self.peek() == "{":
            self.take()
            while self.peek() != "}":
                key = self.name()
                self.take(":")
                out[key] = self.expression()
                if self.peek() == ",":
                    self.take()
            self.take("}")
        return out

    def labels(self) -> list[str]:
        out = []
        if self.peek() == ":":
            self.take()
            out.append(self.name())
            while self.peek() in ("|", ":"):
                self.take()
                if self.peek() == ":":
                    self.take()
                out.append(self.name())
        return out

    def _unnamed(self) -> str:
        self.fresh += 1
        return f"_u{self.fresh}"

    def node(self) -> NodePattern:
        self.take("(")
        name = self.name() if re.match(r"[A-Za-z_`]", self.peek()) else self._unnamed()
        out = NodePattern(name, self.labels(), self.properties())
        self.take(")")
        return out

    def edge(self) -> EdgePattern:
        back = self.peek() == "<"
        if back:
            self.take()
        self.take("-")
        out = EdgePattern(self._unnamed(), [], {}, 0)
        if self.peek() == "[":
            self.take()
            if re.match(r"[A-Za-z_`]", self.peek()):
                out.name = self.name()
            out.kinds = self.labels()
            if self.peek() == "*":
                self.take()
                out.span = self.bounds()
            out.props = self.properties()
            self.take("]")
        self.take("-")
        ahead = self.peek() == ">"
        if ahead:
            self.take()
        out.direction = 0 if back == ahead else 1 if ahead else -1
        return out

    def bounds(self) -> tuple[int, int | None]:
        low = int(self.take()) if self.peek().isdigit() else None
        if self.peek() != "..":
            return (1, None) if low is None else (low, low)
        self.take()
        high = int(self.take()) if self.peek().isdigit() else None
        return (1 if low is None else low), high

    def pattern(self) -> list:
        """Alternating node and edge patterns. A quantified path is an edge with an inner pattern; nodes beside it are added where left out."""
        out: list = []
        if self.peek() == "(" and self.peek(1) == "(":
            out.append(NodePattern(self._unnamed(), [], {}))
        else:
            out.append(self.node())
        while self.peek() in ("-", "<") or self.peek() == "(" and self.peek(1) == "(":
            if self.peek() == "(":
                self.take()
                inner = self.pattern()
                self.take(")")
                if self.peek() == "+":
                    self.take()
                    span = (1, None)
                else:
                    self.take("{")
                    low = int(self.take()) if self.peek().isdigit() else 0
                    high = low
                    if self.peek() == ",":
                        self.take()
                        high = int(self.take()) if self.peek().isdigit() else None
                    self.take("}")
                    span = (low, high)
                out.append(EdgePattern(self._unnamed(), [], {}, 1, span, inner))
                out.append(self.node() if self.peek() == "(" and self.peek(1) != "(" else NodePattern(self._unnamed(), [], {}))
            else:
                out.append(self.edge())
                out.append(self.node())
        return out

    def patterns(self) -> list[list]:
        out = [self.pattern()]
        while self.peek() == ",":
            self.take()
            out.append(self.pattern())
        return out

    def items(self) -> list[tuple[str, str, bool, str]]:
        """(SQL, output name, aggregates, bare variable) of each item of a projection."""
        out = []
        while True:
            start, self.aggregate = self.at, False
            if self.peek() == "*":
                self.take()
                out += [(f"`{n}`", n, False, n) for n in self.scope.kinds if not n.startswith("_")]
            else:
                source = self.expression()
                text = "".join(self.tokens[start : self.at])
                bare = text.strip("`") if text.strip("`") in self.scope.kinds else ""
                name = self.name() if self.took("AS") else re.sub(r"\W+", "_", text).strip("_")
                out.append((source, name, self.aggregate, bare))
            if self.peek() != ",":
                return out
            self.take()


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value) if isinstance(value, int) else f"{value!r}D"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(literal, value))})"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


Procedure = Callable[..., DataFrame]


class Graph:
    """Nodes and edges, with the procedures that CALL knows. Immutable: writing gives another Graph."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, procedures: dict[str, Procedure] | None = None):
        self.nodes, self.edges, self.procedures = nodes, edges, procedures or {}

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def query(self, text: str, params: dict | None = None) -> DataFrame:
        run = _Run(self, Reader(text, params))
        out = run.union()
        if out is None:
            raise CypherFault("a query ends with RETURN")
        return out

    def write(self, text: str, params: dict | None = None) -> Graph:
        run = _Run(self, Reader(text, params))
        run.union()
        return run.graph


class _Run:
    def __init__(self, graph: Graph, reader: Reader, rows: DataFrame | None = None, imported: tuple[str, ...] = ()):
        self.graph, self.r, self.rows, self.imported = graph, reader, rows, imported

    # --- statements
    def union(self) -> DataFrame | None:
        out = self.clauses()
        while self.r.took("UNION"):
            every = self.r.took("ALL")
            self.rows, self.r.scope = None, Scope()
            more = self.clauses()
            out = out.unionByName(more)
            out = out if every else out.distinct()
        if self.r.peek() and self.r.peek() != "}":
            raise CypherFault(f"unexpected {self.r.peek()!r}")
        return out

    def clauses(self) -> DataFrame | None:
        r = self.r
        while r.peek() and r.peek() != "}" and r.word() != "UNION":
            if r.took("OPTIONAL", "MATCH"):
                self.match(True)
            elif r.took("MATCH"):
                self.match(False)
            elif r.took("UNWIND"):
                source = r.expression()
                r.take("AS")
                name = r.name()
                base = self.rows if self.rows is not None else self.graph.spark.range(1).select()
                self.rows = base.withColumn(name, F.explode(F.expr(source)))
                r.scope.kinds[name] = "value"
            elif r.took("CALL"):
                self.call()
            elif r.took("WITH"):
                self.project(True)
            elif r.took("RETURN"):
                return self.project(False)
            elif r.took("CREATE"):
                self.create(r.patterns())
            elif r.took("MERGE"):
                self.merge(r.pattern())
            elif r.took("SET"):
                self.set()
            elif r.took("REMOVE"):
                self.set(True)
            elif r.word() in ("DETACH", "DELETE"):
                detach = r.took("DETACH")
                r.take("DELETE")
                self.delete(detach)
            else:
                raise CypherFault(f"no clause: {r.peek()!r}")
        return None

    def project(self, keep: bool) -> DataFrame:
        r = self.r
        distinct = r.took("DISTINCT")
        items = r.items()
        if self.rows is None:
            raise CypherFault("nothing before RETURN or WITH")
        # a bare node stays a node in WITH and is its id in RETURN
        source = lambda s, bare: f"`{bare}`" if keep and bare else s
        chosen = [F.expr(source(s, b)).alias(o) for s, o, _, b in items]
        passed = [n for n in self.imported if n not in {o for _, o, *_ in items}]
        kinds = {o: r.scope.kinds[b] if keep and b else "list" if s.startswith(("collect", "array(", "filter(", "transform(")) else "value" for s, o, _, b in items}
        order, skip, limit, where = [], None, None, None
        before = Scope(dict(r.scope.kinds))
        grouped = any(a for *_, a, _ in items)
        rows = self.rows
        if grouped:
            keys = [F.expr(source(s, b)).alias(o) for s, o, a, b in items if not a] + [F.col(n) for n in passed]
            rows = rows.groupBy(*keys).agg(*[F.expr(s).alias(o) for s, o, a, _ in items if a]).select(*passed, *[o for _, o, *_ in items])
        elif not distinct and r.word() == "ORDER":
            pass
        else:
            rows = rows.select(*passed, *chosen)
        rows = rows.distinct() if distinct else rows
        late = not grouped and not distinct and r.word() == "ORDER"  # the order may use what isn't returned
        if late:
            hidden = [n for n in r.scope.kinds if n in self.rows.columns and n not in kinds]
            rows = rows.select(*chosen, *hidden, *[n for n in passed if n not in hidden])
            r.scope.kinds = before.kinds | kinds
        else:
            hidden = []
            r.scope.kinds = dict(kinds) | {n: before.kinds[n] for n in passed}
        if r.took("ORDER", "BY"):
            while True:
                by = F.expr(r.expression())
                down = r.word() in ("DESC", "DESCENDING")
                if r.word() in ("DESC", "DESCENDING", "ASC", "ASCENDING"):
                    r.take()
                order.append(by.desc() if down else by.asc())
                if r.peek() != ",":
                    break
                r.take()
        if r.took("SKIP"):
            skip = r.number()
        if r.took("LIMIT"):
            limit = r.number()
        rows = rows.orderBy(*order) if order else rows
        rows = rows.offset(skip) if skip is not None else rows
        rows = rows.limit(limit) if limit is not None else rows
        rows = rows.select(*passed, *kinds) if hidden else rows
        r.scope.kinds = dict(kinds) | {n: before.kinds[n] for n in passed}
        if keep and r.took("WHERE"):
            where = r.expression()
            rows = rows.where(F.expr(where))
        self.rows = rows
        return rows

    def call(self) -> None:
        r = self.r
        if r.peek() == "{":
            r.take()
            outer, kinds = self.rows, dict(r.scope.kinds)
            names: tuple[str, ...] = ()
            if r.took("WITH"):
                names = tuple(b for *_, b in r.items())
            elif outer is not None:
                r.scope.kinds = {}
            start = outer.select(*names).distinct() if names else None
            r.scope.kinds = {n: kinds[n] for n in names}
            inner = _Run(self.graph, r, start, names)
            found = inner.union()
            r.take("}")
            new = {n: k for n, k in r.scope.kinds.items() if n not in names}
            r.scope.kinds = kinds | new
            self.rows = found if outer is None else self._joined(outer, found, list(names), False)
            return
        name = r.name()
        while r.peek() == ".":
            r.take()
            name += "." + r.name()
        if name not in self.graph.procedures:
            raise CypherFault(f"no procedure {name}")
        args = []
        if r.peek() == "(":
            r.take()
            while r.peek() != ")":
                args.append(self.graph.spark.range(1).select(F.expr(r.expression()).alias("x")).first()["x"])
                if r.peek() == ",":
                    r.take()
            r.take(")")
        found = self.graph.procedures[name](self.graph, *args)
        if r.took("YIELD"):
            chosen = []
            while True:
                source = r.name()
                if source not in found.columns:
                    raise CypherFault(f"{name} doesn't yield {source}")
                chosen.append((source, r.name() if r.took("AS") else source))
                if r.peek() != ",":
                    break
                r.take()
            found = found.select(*[F.col(a).alias(b) for a, b in chosen])
        r.scope.kinds |= dict.fromkeys(found.columns, "value")
        self.rows = found if self.rows is None else self.rows.crossJoin(found)
        if r.took("WHERE"):
            self.rows = self.rows.where(F.expr(r.expression()))

    # --- matching
    def match(self, optional: bool) -> None:
        r = self.r
        kinds = r.scope.kinds
        old = dict(kinds)
        patterns = []
        while True:
            # names of this pattern are in scope for its own property maps
            patterns.append(r.pattern())
            if r.peek() != ",":
                break
            r.take()
        found, used = None, []
        for p in patterns:
            rows, new, edges = self.chain(p, old)
            found = rows if found is None else self._joined(found, rows, [n for n in new if n in found.columns], False)
            used += edges
            for n, k in new.items():
                if old.get(n, k) != k:
                    raise CypherFault(f"{n} is already something else")
                kinds[n] = k
        for i, (a, many_a) in enumerate(used):
            for b, many_b in used[:i]:
                if many_a and many_b:
                    found = found.where(~F.arrays_overlap(a, b))
                elif many_a or many_b:
                    found = found.where(~F.array_contains(*((F.col(a), F.col(b)) if many_a else (F.col(b), F.col(a)))))
                else:
                    found = found.where(F.col(a) != F.col(b))
        shown = [n for n in found.columns if not n.startswith("_")]
        found = found.select(*shown)
        where = F.expr(r.expression()) if r.took("WHERE") else None
        if self.rows is None:
            self.rows = found if where is None else found.where(where)
        else:
            self.rows = self._joined(self.rows, found, [n for n in shown if n in old], optional, where)

    def _joined(self, left: DataFrame, right: DataFrame, shared: list[str], optional: bool, where=None) -> DataFrame:
        """left and right by the ids of shared variables; a condition of an optional part keeps left rows."""
        kinds = self.r.scope.kinds
        theirs = right.select(*[F.col(n).alias(f"_r{i}") for i, n in enumerate(shared)], *[n for n in right.columns if n not in shared])
        key = lambda df, c, n: df[c]["id"] if kinds.get(n, "node") == "node" else df[c]
        on = None
        for i, n in enumerate(shared):
            same = key(left, n, n).eqNullSafe(key(theirs, f"_r{i}", n))
            on = same if on is None else on & same
        if where is not None:
            on = where if on is None else on & where
        if on is None:
            return left.crossJoin(theirs)
        return left.join(theirs, on, "left" if optional else "inner").drop(*[f"_r{i}" for i in range(len(shared))])

    def _nodes(self, p: NodePattern, bound: dict[str, str]) -> DataFrame:
        if bound.get(p.name) == "node" and self.rows is not None:
            found = self.rows.select(p.name).where(F.col(p.name)["id"].isNotNull()).distinct()
        else:
            some = self.graph.nodes.where(F.col("label").isin(p.labels)) if p.labels else self.graph.nodes
            return self._where(some, p.props).select(F.struct(*some.columns).alias(p.name))
        if p.labels:
            found = found.where(F.col(p.name)["label"].isin(p.labels))
        for key, value in p.props.items():
            found = found.where(F.col(p.name)[key] == F.expr(value))
        return found

    def _where(self, df: DataFrame, props: dict[str, str]) -> DataFrame:
        for key, value in props.items():
            df = df.where(F.col(key) == F.expr(value))
        return df

    def _steps(self, e: EdgePattern) -> DataFrame:
        """(_from, _to, _edge) of the edges that one hop may take; of an inner pattern, _edge is the array of its edges."""
        if e.inner:
            rows, _, used = self.chain(e.inner, {})
            ends = [p.name for p in (e.inner[0], e.inner[-1])]
            return rows.select(F.col(ends[0])["id"].alias("_from"), F.col(ends[1])["id"].alias("_to"), F.concat(*[F.col(c) if many else F.array(c) for c, many in used]).alias("_edge"))
        found = self.graph.edges.where(F.col("rel").isin(e.kinds)) if e.kinds else self.graph.edges
        found = self._where(found, e.props)
        whole = F.struct(*found.columns).alias("_edge")
        ahead, back = found.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), whole), found.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), whole)
        return ahead if e.direction == 1 else back if e.direction == -1 else ahead.unionByName(back.where("_from <> _to"))

    def _spread(self, rows: DataFrame, last: str, e: EdgePattern) -> DataFrame:
        """rows with _at, the id reached from node `last`, and the edges on the way, over all lengths in the span."""
        low, high = e.span
        steps = self._steps(e)
        if not e.inner:
            steps = steps.withColumn("_edge", F.array("_edge"))
        if high is None:
            steps = held(steps)
        kind = dict(steps.dtypes)["_edge"]
        now = rows.withColumn("_at", F.col(last)["id"]).withColumn(e.name, F.expr(f"CAST(array() AS {kind})"))
        found = now if low == 0 else None
        length = 0
        while high is None or length < high:
            length += 1
            now = now.join(steps, now["_at"] == steps["_from"]).where(~F.arrays_overlap(e.name, "_edge"))
            now = now.withColumn(e.name, F.concat(e.name, "_edge")).withColumn("_at", F.col("_to")).drop("_from", "_to", "_edge")
            if high is None:
                now = held(now)
                if not now.take(1):
                    break
            if length >= low:
                found = now if found is None else found.unionByName(now)
        return found if found is not None else now.limit(0)

    def _plain(self, e: EdgePattern) -> bool:
        """Whether an edge is told by its ends alone, so that joins needn't carry it."""
        return len(e.kinds) == 1 and e.direction != 0 and e.span is None and not e.inner and self.graph.edges.columns == ["src", "dst", "rel"]

    def _edge_of(self, e: EdgePattern, before: str, after: str):
        src, dst = (before, after) if e.direction == 1 else (after, before)
        return F.struct(F.col(src)["id"].alias("src"), F.col(dst)["id"].alias("dst"), F.lit(e.kinds[0]).alias("rel")).alias(e.name)

    def _ring(self, pattern: list, bound: dict[str, str]) -> tuple[DataFrame, dict[str, str], list[tuple[str, bool]]] | None:
        """A pattern that ends in its first node, as two arms that are joined at both ends; None if it isn't a simple ring.

        One arm after the other would make all ways round a node that many edges
        enter; so the arms are cut where the nodes inside have the most edges going out.
        """
        nodes, edges = pattern[0:-1:2], pattern[1::2]
        n = len(edges)
        if n < 3 or any(not isinstance(p, NodePattern) for p in pattern[::2]) or pattern[-1].name != pattern[0].name or pattern[-1].labels or pattern[-1].props:
            return None
        if len({x.name for x in pattern[:-1]}) < 2 * n or any(p.name in bound for p in nodes) or any(e.span is not None or e.inner for e in edges):
            return None
        half = (n + 1) // 2
        outward = [(edges[k].direction == 1) + (edges[k - 1].direction == -1) for k in range(n)]
        cut = max(range(n), key=lambda i: (sum(outward) - outward[i] - outward[(i + half) % n], -i))

        def arm(start: int, count: int) -> DataFrame:
            rows = None
            for k in range(start, start + count):
                e, p = edges[k % n], nodes[k % n]
                steps = self._steps(e).select("_from", "_to", *[] if self._plain(e) else [F.col("_edge").alias(e.name)])
                if rows is None:
                    rows = steps.withColumnsRenamed({"_from": "_start", "_to": "_at"})
                else:
                    inside = self._nodes(p, bound)
                    rows = rows.join(inside, rows["_at"] == inside[p.name]["id"]).drop("_at")
                    rows = rows.join(steps, rows[p.name]["id"] == steps["_from"]).drop("_from").withColumnRenamed("_to", "_at")
            return rows

        left, right = arm(cut, half), arm(cut + half, n - half).withColumnsRenamed({"_start": "_start2", "_at": "_at2"})
        rows = left.join(right, (left["_at"] == right["_start2"]) & (left["_start"] == right["_at2"])).drop("_start2", "_at2")
        for column, p in (("_start", nodes[cut]), ("_at", nodes[(cut + half) % n])):
            ends = self._nodes(p, bound)
            rows = rows.join(ends, rows[column] == ends[p.name]["id"]).drop(column)
        told = [self._edge_of(e, nodes[k].name, nodes[(k + 1) % n].name) for k, e in enumerate(edges) if self._plain(e)]
        return rows.select("*", *told), {p.name: "node" for p in nodes} | {e.name: "edge" for e in edges}, [(e.name, False) for e in edges]

    def chain(self, pattern: list, bound: dict[str, str]) -> tuple[DataFrame, dict[str, str], list[tuple[str, bool]]]:
        """Bindings of a pattern, kinds of its names, and its edge columns with whether each is a list."""
        if isinstance(pattern[-1], NodePattern) and pattern[-1].name in bound and pattern[0].name not in bound and all(not (isinstance(e, EdgePattern) and e.inner) for e in pattern):
            # begin at the bound end
            pattern = [EdgePattern(x.name, x.kinds, x.props, -x.direction, x.span) if isinstance(x, EdgePattern) else x for x in reversed(pattern)]
        if ring := self._ring(pattern, bound):
            return ring
        first = pattern[0]
        rows, kinds, used, last = self._nodes(first, bound), {first.name: "node"}, [], first.name
        for e, p in zip(pattern[1::2], pattern[2::2]):
            many = e.span is not None
            if many:
                rows = self._spread(rows, last, e)
            else:
                steps = self._steps(e)
                rows = rows.join(steps, rows[last]["id"] == steps["_from"]).withColumn("_at", F.col("_to")).withColumnRenamed("_edge", e.name).drop("_from", "_to")
            used.append((e.name, many))
            kinds[e.name] = "edges" if many else "edge"
            if p.name in kinds:
                rows = rows.where(F.col(p.name)["id"] == F.col("_at"))
            else:
                ends = self._nodes(p, bound)
                rows = rows.join(ends, rows["_at"] == ends[p.name]["id"])
                kinds[p.name] = "node"
            rows, last = rows.drop("_at"), p.name
        return rows, kinds, used

    # --- writing
    def _source(self) -> DataFrame:
        return self.rows if self.rows is not None else self.graph.spark.range(1).select()

    def _as(self, df: DataFrame, like: DataFrame) -> DataFrame:
        """df with the columns and types of like, missing ones null."""
        kinds = dict(like.dtypes)
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in like.columns])

    def _new_node(self, rows: DataFrame, p: NodePattern) -> DataFrame:
        if "id" not in p.props:
            raise CypherFault("a new node needs an id")
        columns = {k: F.expr(v) for k, v in p.props.items()} | ({"label": F.lit(p.labels[0])} if p.labels else {})
        unknown = set(columns) - set(self.graph.nodes.columns)
        if unknown:
            raise CypherFault(f"nodes have no property {sorted(unknown)[0]}")
        return rows.withColumn(p.name, F.struct(*[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in self.graph.nodes.dtypes]))

    def create(self, patterns: list[list]) -> None:
        rows, kinds, g = self._source(), self.r.scope.kinds, self.graph
        nodes, edges = g.nodes, g.edges
        for p in patterns:
            for n in p[::2]:
                if n.name not in kinds:
                    rows = self._new_node(rows, n)
                    kinds[n.name] = "node"
                    nodes = nodes.unionByName(rows.select(f"{n.name}.*").distinct())
            edges = self._with_edges(rows, p, edges)
        self.rows, self.graph = rows, Graph(nodes, edges, g.procedures)

    def _with_edges(self, rows: DataFrame, p: list, edges: DataFrame) -> DataFrame:
        for a, e, b in zip(p[::2], p[1::2], p[2::2]):
            if e.direction == 0 or len(e.kinds) != 1 or e.span:
                raise CypherFault("a new relationship needs one type and a direction")
            src, dst = (a, b) if e.direction == 1 else (b, a)
            new = rows.select(F.col(src.name)["id"].alias("src"), F.col(dst.name)["id"].alias("dst"), F.lit(e.kinds[0]).alias("rel"), *[F.expr(v).alias(k) for k, v in e.props.items()])
            edges = edges.unionByName(self._as(new, edges))
        return edges

    def merge(self, p: list) -> None:
        rows, kinds, g = self._source(), self.r.scope.kinds, self.graph
        nodes, edges = g.nodes, g.edges
        on = {"CREATE": [], "MATCH": []}
        for n in p[::2]:
            if n.name in kinds:
                continue
            rows = self._new_node(rows, n)
            kinds[n.name] = "node"
        start = self.r.at
        while self.r.took("ON"):
            when = self.r.take().upper()
            self.r.take("SET")
            on[when] += self.assignments()
        if on["CREATE"] or on["MATCH"]:
            if len(p) > 1 or start == self.r.at:
                raise CypherFault("ON CREATE and ON MATCH follow the MERGE of a node")
        for n in p[::2]:
            if n.name in dict.fromkeys(c for c in rows.columns) and n.props:
                new = rows.select(f"{n.name}.*").distinct()
                ids = nodes.select(F.col("id").alias("_id"))
                missing = new.join(ids, new["id"] == ids["_id"], "left_anti")
                known = new.join(ids, new["id"] == ids["_id"], "left_semi").select(F.col("id").alias("_id"))
                for _, prop, value in on["CREATE"]:
                    missing = missing.withColumn(prop, F.expr(value.replace(f"`{n.name}`.", "")).cast(dict(nodes.dtypes)[prop]))
                for _, prop, value in on["MATCH"]:
                    hit = nodes.join(known.withColumn("_hit", F.lit(True)), nodes["id"] == F.col("_id"), "left")
                    nodes = hit.withColumn(prop, F.when(F.col("_hit"), F.expr(value.replace(f"`{n.name}`.", "")).cast(dict(nodes.dtypes)[prop])).otherwise(F.col(prop))).drop("_id", "_hit")
                nodes = nodes.unionByName(missing)
        if len(p) > 1:
            both = self._with_edges(rows, p, edges.limit(0)).distinct()
            old = edges.select(*[F.col(c).alias(f"_{c}") for c in ("src", "dst", "rel")])
            edges = edges.unionByName(both.join(old, (both["src"] == old["_src"]) & (both["dst"] == old["_dst"]) & (both["rel"] == old["_rel"]), "left_anti"))
        self.rows, self.graph = rows, Graph(nodes, edges, g.procedures)

    def assignments(self, remove: bool = False) -> list[tuple[str, str, str]]:
        out = []
        while True:
            name = self.r.name()
            prop = self.r._property()
            if not remove:
                self.r.take("=")
            out.append((name, prop, "NULL" if remove else self.r.expression()))
            if self.r.peek() != ",":
                return out
            self.r.take()

    def set(self, remove: bool = False) -> None:
        g = self.graph
        nodes, edges = g.nodes, g.edges
        for name, prop, value in self.assignments(remove):
            kind = self.r.scope.kinds.get(name)
            if kind not in ("node", "edge"):
                raise CypherFault(f"can't set a property of {name}")
            keys = ["id"] if kind == "node" else ["src", "dst", "rel"]
            table = nodes if kind == "node" else edges
            if prop not in table.columns:
                raise CypherFault(f"no property {prop}")
            # one row of the match decides for each entity, the greatest value if they differ
            new = self._source().where(F.col(name).isNotNull()).groupBy(*[F.col(name)[k].alias(f"_{k}") for k in keys]).agg(F.max(F.expr(value)).alias("_v")).withColumn("_hit", F.lit(True))
            on = [table[k] == new[f"_{k}"] for k in keys]
            table = table.join(new, on, "left").withColumn(prop, F.when(F.col("_hit"), F.col("_v").cast(dict(table.dtypes)[prop])).otherwise(F.col(prop))).select(*table.columns)
            nodes, edges = (table, edges) if kind == "node" else (nodes, table)
        self.graph = Graph(nodes, edges, g.procedures)

    def delete(self, detach: bool) -> None:
        g = self.graph
        nodes, edges = g.nodes, g.edges
        while True:
            name = self.r.name()
            kind = self.r.scope.kinds.get(name)
            if kind not in ("node", "edge"):
                raise CypherFault(f"can't delete {name}")
            rows = self._source().where(F.col(name).isNotNull())
            if kind == "node":
                gone = rows.select(F.col(name)["id"].alias("_id")).distinct()
                touching = lambda side: edges.join(gone, edges[side] == gone["_id"], "left_semi")  # noqa: B023, E731
                if detach:
                    for side in ("src", "dst"):
                        edges = edges.join(gone, edges[side] == gone["_id"], "left_anti")
                elif touching("src").unionByName(touching("dst")).take(1):
                    raise CypherFault(f"{name} still has relationships")
                nodes = nodes.join(gone, nodes["id"] == gone["_id"], "left_anti")
            else:
                gone = rows.select(*[F.col(name)[k].alias(f"_{k}") for k in ("src", "dst", "rel")]).distinct()
                edges = edges.join(gone, [edges[k] == gone[f"_{k}"] for k in ("src", "dst", "rel")], "left_anti")
            if self.r.peek() != ",":
                break
            self.r.take()
        self.graph = Graph(nodes, edges, g.procedures)


def run(text: str, nodes: DataFrame, edges: DataFrame, params: dict | None = None, procedures: dict[str, Procedure] | None = None) -> DataFrame:
    """The result of a reading query."""
    return Graph(nodes, edges, procedures).query(text, params)
