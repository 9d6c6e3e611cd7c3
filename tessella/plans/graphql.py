"""GraphQL reads over nodes and edges, compiled to nested columns.

    { customer(first: 3, nation: "nation:1", orderBy: "id") { id value LOCATED_IN { id PART_OF { id } } in_PLACED_BY(limit: 2) { id } } }

A root field names a label, its arguments are equality filters on properties, or
first/limit, offset, after, orderBy. Inside, a field is a property; a relation's
name gives the neighbours along it as an array, in_NAME those against it, each
with its own filters and limit; `<label>_connection` gives edges { cursor node }
and pageInfo. Aliases, variables, named fragments, inline fragments, @skip and
@include are resolved before compiling. The result has one row for each root
field: field (its alias) and data, JSON text of the array.

Children are joined by one equi-join for each nested field, and gathered for each
parent; a parent's children are its row anyway, as the result nests them.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class GraphqlFault(ValueError):
    """The document can't be read."""


_TOKEN = re.compile(r"[\s,]*(?:#[^\n]*\n[\s,]*)*(\"(?:[^\"\\]|\\.)*\"|\.\.\.|-?\d+(?:\.\d+)?|[A-Za-z_]\w*|[$@!{}()\[\]:=])")
_PAGING = ("first", "limit", "offset", "after", "last", "before", "orderBy")


@dataclass
class Selection:
    name: str
    alias: str
    args: dict = field(default_factory=dict)
    fields: list[Selection] = field(default_factory=list)


class _Reader:
    def __init__(self, text: str, variables: dict | None):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise GraphqlFault(f"unexpected {text[at : at + 20]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at, self.variables = 0, dict(variables or {})
        self.fragments: dict[str, int] = {}

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        t = self.peek()
        if not t or wanted and t != wanted:
            raise GraphqlFault(f"expected {wanted or 'more'}, found {t or 'the end'!r}")
        self.at += 1
        return t

    def skip_block(self) -> None:
        depth = 0
        while True:
            t = self.take()
            depth += (t == "{") - (t == "}")
            if t == "}" and not depth:
                return

    def document(self) -> list[Selection]:
        start = None
        while self.peek():
            if self.peek() == "fragment":
                self.take()
                name = self.take()
                self.take("on")
                self.take()
                self.fragments[name] = self.at
                self.skip_block()
            else:
                if start is not None:
                    raise GraphqlFault("one operation at a time")
                if self.peek() == "query":
                    self.take()
                    if self.peek() not in "({":
                        self.take()
                    if self.peek() == "(":
                        self.definitions()
                elif self.peek() != "{":
                    raise GraphqlFault(f"no query: {self.peek()!r}")
                start = self.at
                self.skip_block()
        if start is None:
            raise GraphqlFault("no query")
        self.at = start
        return self.selections()

    def definitions(self) -> None:
        self.take("(")
        while self.peek() != ")":
            self.take("$")
            name = self.take()
            self.take(":")
            while self.peek() not in ("$", ")", "="):
                self.take()
            if self.peek() == "=":
                self.take()
                self.variables.setdefault(name, self.value())
        self.take(")")

    def value(self):
        t = self.take()
        if t == "$":
            return self.variables.get(self.take())
        if t == "[":
            out = []
            while self.peek() != "]":
                out.append(self.value())
            self.take("]")
            return out
        if t[0] == '"':
            return json.loads(t)
        if re.fullmatch(r"-?\d+(\.\d+)?", t):
            return json.loads(t)
        return {"true": True, "false": False, "null": None}.get(t, t)

    def arguments(self) -> dict:
        out = {}
        if self.peek() == "(":
            self.take()
            while self.peek() != ")":
                name = self.take()
                self.take(":")
                out[name] = self.value()
            self.take(")")
        return out

    def wanted(self) -> bool:
        keep = True
        while self.peek() == "@":
            self.take()
            which = self.take()
            test = bool(self.arguments().get("if"))
            keep &= test if which == "include" else not test if which == "skip" else True
        return keep

    def selections(self) -> list[Selection]:
        self.take("{")
        out: list[Selection] = []
        while self.peek() != "}":
            if self.peek() == "...":
                self.take()
                if self.peek() == "on" or self.peek() in "@{":
                    if self.peek() == "on":
                        self.take()
                        self.take()
                    keep = self.wanted()
                    inner = self.selections()
                else:
                    name = self.take()
                    keep = self.wanted()
                    if name not in self.fragments:
                        raise GraphqlFault(f"no fragment {name}")
                    here, self.at = self.at, self.fragments[name]
                    inner = self.selections()
                    self.at = here
                out += inner if keep else []
                continue
            name = alias = self.take()
            if self.peek() == ":":
                self.take()
                name = self.take()
            args, keep = self.arguments(), self.wanted()
            fields = self.selections() if self.peek() == "{" else []
            if keep:
                out.append(Selection(name, alias, args, fields))
        self.take("}")
        return out


def run(text: str, nodes: DataFrame, edges: DataFrame, variables: dict | None = None) -> DataFrame:
    """(field, data) of each root field, data being JSON."""
    out = None
    for s in _Reader(text, variables).document():
        found = _root(s, nodes, edges).select(F.lit(s.alias).alias("field"), F.to_json("data", {"ignoreNullFields": "false"}).alias("data"))
        out = found if out is None else out.unionByName(found)
    return out


def _filtered(rows: DataFrame, args: dict) -> DataFrame:
    for name, value in args.items():
        if name in _PAGING:
            continue
        if name not in rows.columns:
            raise GraphqlFault(f"no property {name}")
        rows = rows.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name).eqNullSafe(F.lit(value)))
    return rows


def _order(args: dict) -> list[Column]:
    by = args.get("orderBy", "id")
    down = by.startswith("-") or by.upper().endswith("_DESC")
    name = re.sub(r"(?i)_(desc|asc)$", "", by.lstrip("-"))
    return [F.desc(name) if down else F.asc(name), F.asc("id")]


def _object(s: Selection, rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (nodes) with column _o, the struct that the selection asks for."""
    parts = []
    for i, f in enumerate(s.fields):
        if not f.fields:
            if f.name == "__typename":
                parts.append(F.col("label").alias(f.alias))
            elif f.name in nodes.columns:
                parts.append(F.col(f.name).alias(f.alias))
            else:
                raise GraphqlFault(f"no property {f.name}")
            continue
        against = f.name.startswith("in_")
        rel = f.name[3:] if against else f.name
        mine, other = ("dst", "src") if against else ("src", "dst")
        links = edges.where(F.col("rel") == rel).select(F.col(mine).alias("_parent"), F.col(other).alias("_child"))
        parents = rows.select(F.col("id").alias("_parent")).distinct()
        some = _filtered(nodes, f.args)
        kids = links.join(parents, "_parent", "left_semi").join(some, F.col("_child") == F.col("id"))
        most, skip = f.args.get("first", f.args.get("limit")), f.args.get("offset", 0)
        kids = kids.withColumn("_n", F.row_number().over(Window.partitionBy("_parent").orderBy(*_order(f.args))))
        if most is not None or skip:
            kids = kids.where((F.col("_n") > skip) & (F.col("_n") <= skip + (most if most is not None else 1 << 62)))
        kids = _object(f, kids, nodes, edges)
        lists = kids.groupBy("_parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_o"))), lambda x: x["_o"]).alias(f"_l{i}"))
        kind = dict(lists.dtypes)[f"_l{i}"]
        rows = rows.join(lists.withColumnRenamed("_parent", f"_p{i}"), F.col("id") == F.col(f"_p{i}"), "left")
        parts.append(F.coalesce(f"_l{i}", F.expr(f"CAST(array() AS {kind})")).alias(f.alias))
    return rows.withColumn("_o", F.struct(*parts))


def _root(s: Selection, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    connection = s.name.endswith("_connection")
    label = s.name.removesuffix("_connection")
    rows = _filtered(nodes.where(F.col("label") == label), s.args)
    order, back = _order(s.args), "last" in s.args
    for mark, test in (("after", lambda c, v: c > v), ("before", lambda c, v: c < v)):
        if s.args.get(mark) is not None:
            rows = rows.where(test(F.col("id"), F.lit(s.args[mark])))
    most = s.args.get("first", s.args.get("limit", s.args.get("last")))
    page = rows.orderBy(F.desc("id")) if back else rows.orderBy(*order)
    page = page.offset(s.args["offset"]) if s.args.get("offset") else page
    page = page.limit(most + 1) if most is not None else page  # one more tells whether there is another page
    place = F.row_number().over(Window.orderBy(*([F.desc("id")] if back else order)))
    page = page.withColumn("_n", place)
    shown = page.where(F.col("_n") <= most) if most is not None else page
    node = next((f for e in s.fields if e.name == "edges" for f in e.fields if f.name == "node"), None) if connection else s
    if node is None:
        raise GraphqlFault("a connection asks for edges { node { .. } }")
    objects = _object(node, shown, nodes, edges)
    if not connection:
        return objects.agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_o"))), lambda x: x["_o"]).alias("data"))
    edge = F.struct(F.col("id").alias("cursor"), F.col("_o").alias("node"))
    key = -F.col("_n") if back else F.col("_n")
    listed = objects.agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), edge.alias("e")))), lambda x: x["e"]).alias("edges"))
    more = page.agg((F.count(F.lit(1)) > (most if most is not None else 1 << 62)).alias("m"))
    info = F.struct(F.when(F.lit(back), F.lit(False)).otherwise(F.col("m")).alias("hasNextPage"), F.when(F.lit(back), F.col("m")).otherwise(F.lit(False)).alias("hasPreviousPage"), F.try_element_at(F.col("edges"), F.lit(-1))["cursor"].alias("endCursor"))
    return listed.crossJoin(more).select(F.struct("edges", info.alias("pageInfo")).alias("data"))  # two single rows
