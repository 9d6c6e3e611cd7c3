"""SPARQL over a table of quads (g, s, p, o), compiled to joins.

Terms are N-Triples text: <iri>, "literal", "5"^^<datatype>, "Haus"@de, _:blank;
a quoted triple is << s p o >> with its terms between unit separators. g is null
in the default graph. A triple is there once in each graph.

    PREFIX ex: <http://example.org/>
    SELECT ?n (COUNT(*) AS ?customers) WHERE { ?c ex:in ?n . ?c ex:balance ?b FILTER(?b > 9000) } GROUP BY ?n

SELECT with property paths, OPTIONAL, UNION, MINUS, FILTER [NOT] EXISTS, BIND,
VALUES, sub-SELECT, GRAPH, FROM, SERVICE (other datasets by name), aggregates,
HAVING and solution modifiers; ASK, CONSTRUCT, DESCRIBE; updates give a new
Dataset. In results a term is its lexical form, a computed number or truth value
is one. Comparison is by number where both sides are numbers, else by text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import held

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_UNIT = "\x1f"


class SparqlFault(ValueError):
    """The text can't be read."""


_TOKEN = re.compile(
    r"\s*(?:#[^\n]*\n\s*)*(?:(<<|>>)|(<[^<>\s]*>)|(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(@[A-Za-z][\w-]*)|(\^\^)|([?$]\w+)|(_:\w+)|(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    r"|([A-Za-z][\w.-]*(?<!\.)?:[\w.%-]*(?<!\.)|:[\w.%-]*(?<!\.))|([A-Za-z_]\w*)|(&&|\|\||!=|<=|>=|[-{}()\[\].,;*+/|^!?=<>]))"
)


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lexical(t: str) -> str:
    """SQL of a term's text."""
    body = f"regexp_extract({t}, {_quote(chr(94) + '(?s)' + chr(34) + '(.*)' + chr(34) + '(?:@[A-Za-z0-9-]+|' + chr(92) + '^' + chr(92) + '^<[^>]*>)?$')}, 1)".replace("^(?s)", "(?s)^")
    plain = f"replace(replace(replace({body}, '\\\\\"', '\"'), '\\\\n', '\\n'), '\\\\\\\\', '\\\\')"
    return f"(CASE WHEN startswith({t}, '<') THEN substring({t}, 2, length({t}) - 2) WHEN startswith({t}, '\"') THEN {plain} ELSE {t} END)"


def number(t: str) -> str:
    """SQL of a numeric literal's value, else null."""
    return f"(CASE WHEN rlike({t}, {_quote(chr(92) + '^' + chr(92) + '^<' + XSD + '(integer|decimal|double|float|int|long|short|byte|nonNegativeInteger)>$')}) THEN try_cast({lexical(t)} AS DOUBLE) END)"


@dataclass
class Value:
    """SQL of a value and its kind: term, num, str, bool."""

    sql: str
    kind: str = "term"

    def num(self) -> str:
        return {"term": number(self.sql), "num": self.sql, "str": f"try_cast({self.sql} AS DOUBLE)", "bool": f"CAST({self.sql} AS DOUBLE)"}[self.kind]

    def str(self) -> str:
        return {"term": lexical(self.sql), "num": _shown(self.sql), "str": self.sql, "bool": f"CAST({self.sql} AS STRING)"}[self.kind]

    def bool(self) -> str:
        truth = f"(CASE WHEN endswith({self.sql}, '#boolean>') THEN {lexical(self.sql)} = 'true' ELSE coalesce({number(self.sql)} <> 0, {lexical(self.sql)} <> '') END)"
        return {"term": truth, "num": f"({self.sql} <> 0)", "str": f"({self.sql} <> '')", "bool": self.sql}[self.kind]

    def term(self) -> str:
        if self.kind == "term":
            return self.sql
        if self.kind == "num":
            whole = f"{self.sql} = floor({self.sql})"
            return f"concat('\"', {_shown(self.sql)}, '\"^^<{XSD}', CASE WHEN {whole} THEN 'integer' ELSE 'decimal' END, '>')"
        if self.kind == "bool":
            return f"concat('\"', CAST({self.sql} AS STRING), '\"^^<{XSD}boolean>')"
        return f"concat('\"', replace(replace(replace({self.sql}, '\\\\', '\\\\\\\\'), '\"', '\\\\\"'), '\\n', '\\\\n'), '\"')"


def _shown(n: str) -> str:
    return f"(CASE WHEN {n} = floor({n}) THEN CAST(CAST({n} AS BIGINT) AS STRING) ELSE CAST({n} AS STRING) END)"


@dataclass
class Rows:
    """Solutions: a frame with a column for each variable, its kind, variables that may be unbound, and filters that wait for outer variables."""

    df: DataFrame
    kinds: dict[str, str] = field(default_factory=dict)
    maybe: set[str] = field(default_factory=set)
    late: list[str] = field(default_factory=list)


class Dataset:
    """Quads and the prefixes known without declaration. Immutable: an update gives another Dataset."""

    def __init__(self, quads: DataFrame, services: dict[str, Dataset] | None = None):
        self.quads, self.services = quads.select("g", "s", "p", "o"), services or {}

    @property
    def spark(self) -> SparkSession:
        return self.quads.sparkSession

    @classmethod
    def of_triples(cls, triples: DataFrame) -> Dataset:
        return cls(triples.select(F.lit(None).cast("string").alias("g"), "s", "p", "o"))

    def query(self, text: str) -> DataFrame:
        return _Query(self, text).run()

    def update(self, text: str) -> Dataset:
        return _Query(self, text).updated()


_AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT")
_PARTS = {"YEAR": "year", "MONTH": "month", "DAY": "day", "HOURS": "hour", "MINUTES": "minute", "SECONDS": "second"}
_DIGESTS = {"MD5": "md5({})", "SHA1": "sha1({})", "SHA256": "sha2({}, 256)", "SHA384": "sha2({}, 384)", "SHA512": "sha2({}, 512)"}


class _Query:
    def __init__(self, data: Dataset, text: str):
        self.data, self.tokens, self.at, self.fresh = data, [], 0, 0
        at, text = 0, text.strip() + "\n"
        while text[at:].strip() and not re.fullmatch(r"(\s*#[^\n]*\n)*\s*", text[at:]):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlFault(f"unexpected {text[at : at + 20]!r}")
            self.tokens.append(next(g for g in m.groups() if g is not None))
            at = m.end()
        self.prefixes = {"rdf": RDF, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": XSD, "owl": "http://www.w3.org/2002/07/owl#"}
        self.scope: dict[str, str] = {}
        self.aggregates: dict[str, tuple[str, str]] | None = None
        self.quads = data.quads
        self.graph: str | None = None  # None: default graph; a term or a variable otherwise

    # --- tokens
    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ""

    def word(self, k: int = 0) -> str:
        return self.peek(k).upper()

    def take(self, wanted: str | None = None) -> str:
        t = self.peek()
        if not t or wanted and t.upper() != wanted:
            raise SparqlFault(f"expected {wanted or 'more'}, found {t or 'the end'!r}")
        self.at += 1
        return t

    def took(self, *wanted: str) -> bool:
        if all(self.word(k) == w for k, w in enumerate(wanted)):
            self.at += len(wanted)
            return True
        return False

    def new(self) -> str:
        self.fresh += 1
        return f"_b{self.fresh}"

    def prologue(self) -> None:
        while self.word() in ("PREFIX", "BASE"):
            if self.take().upper() == "BASE":
                self.prefixes["base"] = self.take()[1:-1]
            else:
                name = self.take().rstrip(":")
                self.prefixes[name] = self.take()[1:-1]

    # --- terms: a term's text, or ?name
    def iri(self, t: str) -> str:
        if t.startswith("<"):
            return t
        prefix, _, local = t.partition(":")
        if prefix not in self.prefixes:
            raise SparqlFault(f"unknown prefix {prefix!r}")
        return f"<{self.prefixes[prefix]}{local}>"

    def term(self) -> str:
        t = self.take()
        if t == "<<":
            parts = [self.term(), self.verb_term(), self.term()]
            self.take(">>")
            return f"<<{_UNIT}" + _UNIT.join(parts) + f"{_UNIT}>>"
        if t[0] in "?$":
            return "?" + t[1:]
        if t.startswith("_:"):
            return f"?_n{t[2:]}"
        if t == "[":
            raise SparqlFault("blank node property lists aren't supported")
        if t[0] in "\"'":
            text = '"' + t[1:-1].replace('"', '\\"').replace('\\\\"', '\\"') + '"'
            if self.peek().startswith("@"):
                return text + self.take()
            if self.peek() == "^^":
                self.take()
                return f"{text}^^{self.iri(self.take())}"
            return text
        if t[0].isdigit() or t in "+-" and self.peek()[:1].isdigit():
            t = t + self.take() if t in "+-" else t
            return f'"{t}"^^<{XSD}{"integer" if re.fullmatch("[+-]?[0-9]+", t) else "decimal" if "e" not in t.lower() else "double"}>'
        if t.lower() in ("true", "false"):
            return f'"{t.lower()}"^^<{XSD}boolean>'
        return self.iri(t)

    def verb_term(self) -> str:
        if self.peek() == "a":
            self.take()
            return f"<{RDF}type>"
        return self.term()

    # --- property paths: ("iri", x), ("inv", p), ("seq", p, q), ("alt", p, q), ("rep", p, least, many), ("not", [..], [..])
    def path(self):
        out = self.sequence()
        while self.peek() == "|":
            self.take()
            out = ("alt", out, self.sequence())
        return out

    def sequence(self):
        out = self.step()
        while self.peek() == "/":
            self.take()
            out = ("seq", out, self.step())
        return out

    def step(self):
        if self.peek() == "^":
            self.take()
            return ("inv", self.step())
        if self.peek() == "!":
            self.take()
            return self.negated()
        if self.peek() == "(":
            self.take()
            out = self.path()
            self.take(")")
        else:
            out = ("iri", self.verb_term())
        while self.peek() in ("*", "+", "?"):
            mark = self.take()
            out = ("rep", out, 0 if mark in "*?" else 1, mark != "?")
        return out

    def negated(self):
        ahead, back = [], []
        many = self.peek() == "("
        if many:
            self.take()
        while True:
            inverse = self.peek() == "^"
            if inverse:
                self.take()
            (back if inverse else ahead).append(self.verb_term())
            if not (many and self.peek() == "|"):
                break
            self.take()
        if many:
            self.take(")")
        return ("not", ahead, back)

    def triples(self) -> DataFrame:
        """(s, p, o) of the graph in question; with a variable graph also its name."""
        if self.graph is None:
            return self.quads.where("g IS NULL").select("s", "p", "o")
        if self.graph.startswith("?"):
            return self.quads.where("g IS NOT NULL")
        return self.quads.where(F.col("g") == self.graph).select("s", "p", "o")

    def paths(self, path, start: str | None = None) -> DataFrame:
        """(s, o) that a path joins. start, a constant, seeds repetition."""
        kind, t = path[0], self.triples()
        if kind == "iri":
            return t.where(F.col("p") == path[1]).select("s", "o")
        if kind == "inv":
            found = self.paths(path[1])
            return found.select(F.col("o").alias("s"), F.col("s").alias("o"))
        if kind == "alt":
            return self.paths(path[1], start).unionByName(self.paths(path[2], start))
        if kind == "seq":
            a, b = self.paths(path[1], start).withColumnRenamed("o", "_m"), self.paths(path[2]).withColumnRenamed("s", "_m")
            return a.join(b, "_m").select("s", "o")
        if kind == "not":
            ahead = t.where(~F.col("p").isin(path[1])).select("s", "o") if path[1] or not path[2] else None
            back = t.where(~F.col("p").isin(path[2])).select(F.col("o").alias("s"), F.col("s").alias("o")) if path[2] else None
            return ahead if back is None else back if ahead is None else ahead.unionByName(back)
        _, inner, least, many = path
        step = self.paths(inner).distinct()
        ends = t.select("s").unionByName(t.select(F.col("o").alias("s"))).distinct()
        if start is not None:
            ends = self.data.spark.createDataFrame([(start,)], "s string")
        same = ends.select("s", F.col("s").alias("o"))
        if not many:
            return same.unionByName(step).distinct()
        step = held(step)
        links = step.select(F.col("s").alias("_m"), F.col("o").alias("_n"))
        front = held(same.join(links, same["o"] == links["_m"]).select("s", F.col("_n").alias("o")).distinct())
        found = front
        while front.take(1):
            new = front.join(links, front["o"] == links["_m"]).select("s", F.col("_n").alias("o")).distinct()
            front = held(new.join(found, ["s", "o"], "left_anti"))
            found = found.unionByName(front)
        return found if least else found.unionByName(same).distinct()

    def matched(self, s: str, verb, o: str) -> Rows:
        """Solutions of one triple pattern."""
        if verb[0] == "iri":
            df, parts = self.triples(), [("s", s), ("p", verb[1]), ("o", o)]
        else:
            df, parts = self.paths(verb, None if s.startswith("?") else s), [("s", s), ("o", o)]
        if self.graph and self.graph.startswith("?"):
            if verb[0] != "iri":
                raise SparqlFault("a path in a graph variable")
            parts.append(("g", self.graph))
        out: dict[str, F.Column] = {}

        def bind(name: str, column) -> None:
            nonlocal df
            if name in out:
                df = df.where(out[name] == column)
            else:
                out[name] = column

        for column, t in parts:
            c = F.col(column)
            if t.startswith("?"):
                bind(t[1:], c)
            elif t.startswith("<<") and "?" in t:
                inner = t.split(_UNIT)[1:-1]
                got = F.split(c, _UNIT)
                df = df.where(c.startswith("<<") & (F.size(got) == 5))
                for i, x in enumerate(inner):
                    if x.startswith("?"):
                        bind(x[1:], got[i + 1])
                    else:
                        df = df.where(got[i + 1] == x)
            else:
                df = df.where(c == t)
        return Rows(df.select(*[c.alias(n) for n, c in out.items()]), dict.fromkeys(out, "term"))

    def block(self) -> list[tuple]:
        """Triple patterns up to something else."""
        out = []
        while self.peek() and self.peek() not in "{}" and self.word() not in ("FILTER", "OPTIONAL", "MINUS", "BIND", "VALUES", "GRAPH", "SERVICE", "UNION"):
            s = self.term()
            while True:
                verb = ("iri", self.term()) if self.peek()[:1] in ("?", "$") else self.path()
                while True:
                    out.append((s, verb, self.term()))
                    if self.peek() != ",":
                        break
                    self.take()
                if self.peek() != ";":
                    break
                while self.peek() == ";":
                    self.take()
                if self.peek() in (".", "}") or not self.peek():
                    break
            if self.peek() == ".":
                self.take()
        return out

    # --- groups
    def unit(self) -> Rows:
        return Rows(self.data.spark.range(1).select())

    def join(self, a: Rows, b: Rows, how: str = "inner") -> Rows:
        shared = [n for n in b.kinds if n in a.kinds]
        for n in shared:
            if a.kinds[n] != b.kinds[n]:
                a, b = self.as_terms(a, [n]), self.as_terms(b, [n])
        theirs = b.df.select(*[F.col(n).alias(f"_r_{n}" if n in shared else n) for n in b.kinds])
        on = None
        for n in shared:
            mine, other = a.df[n], theirs[f"_r_{n}"]
            same = mine == other
            if n in a.maybe or n in b.maybe:
                same = same | mine.isNull() | other.isNull()
            on = same if on is None else on & same
        kinds = a.kinds | {n: k for n, k in b.kinds.items() if n not in a.kinds}
        late = []
        for f in b.late if how != "inner" else a.late + b.late:
            if how == "inner":
                late.append(f)
            else:
                on = F.expr(f) if on is None else on & F.expr(f)
        if how in ("left_semi", "left_anti"):
            if on is None:
                keep = bool(b.df.take(1)) == (how == "left_semi")
                return a if keep else Rows(a.df.limit(0), a.kinds, a.maybe, a.late)
            return Rows(a.df.join(theirs, on, how), a.kinds, a.maybe, a.late)
        df = a.df.join(theirs, on, how) if on is not None else a.df.crossJoin(theirs) if how == "inner" else a.df.join(theirs, F.lit(True), how)
        df = df.select(*[F.coalesce(n, f"_r_{n}").alias(n) if n in shared else F.col(n) for n in kinds])
        maybe = {n for n in a.maybe if n not in b.kinds or n in b.maybe or how == "left"} | {n for n in b.maybe if n not in a.kinds}
        if how == "left":
            maybe |= {n for n in b.kinds if n not in a.kinds}
        return Rows(df, kinds, maybe, late if how == "inner" else list(a.late))

    def as_terms(self, rows: Rows, names: list[str]) -> Rows:
        df = rows.df
        for n in names:
            df = df.withColumn(n, F.expr(Value(f"`{n}`", rows.kinds[n]).term()))
        return Rows(df, rows.kinds | dict.fromkeys(names, "term"), rows.maybe, rows.late)

    def group(self) -> Rows:
        self.take("{")
        if self.word() == "SELECT":
            outer, self.scope = self.scope, {}
            out = self.select()
            self.scope = outer
            self.take("}")
            return out
        rows, filters = self.unit(), []
        while self.peek() != "}":
            if self.took("FILTER"):
                no = self.took("NOT", "EXISTS")
                if no or self.took("EXISTS"):
                    filters.append(("left_anti" if no else "left_semi", self.group()))
                else:
                    filters.append(("where", self.at))
                    self.skip_expression()
            elif self.took("OPTIONAL"):
                rows = self.join(rows, self.group(), "left")
            elif self.took("MINUS"):
                other = self.group()
                if set(other.kinds) & set(rows.kinds):
                    rows = self.join(rows, other, "left_anti")
            elif self.took("BIND"):
                self.take("(")
                self.scope = rows.kinds
                value = self.expression()
                self.take("AS")
                name = self.take()[1:]
                self.take(")")
                rows = Rows(rows.df.withColumn(name, F.expr(value.sql)), rows.kinds | {name: value.kind}, rows.maybe | {name}, rows.late)
            elif self.took("VALUES"):
                rows = self.join(rows, self.values())
            elif self.took("GRAPH"):
                before, self.graph = self.graph, self.term()
                inner = self.group()
                self.graph = before
                rows = self.join(rows, inner)
            elif self.took("SERVICE"):
                silent = self.took("SILENT")
                name = self.term()
                other = self.data.services.get(name[1:-1])
                if other is None and not silent:
                    raise SparqlFault(f"no service {name}")
                before, self.quads = self.quads, other.quads if other else self.quads.limit(0)
                inner = self.group()
                self.quads = before
                rows = self.join(rows, inner)
            elif self.peek() == "{":
                found = self.group()
                while self.took("UNION"):
                    found = self.union(found, self.group())
                rows = self.join(rows, found)
            elif self.peek() == ".":
                self.take()
            else:
                for s, verb, o in self.block():
                    rows = self.join(rows, self.matched(s, verb, o))
        end = self.at
        for kind, what in filters:
            if kind != "where":
                rows = self.join(rows, what, kind)
                continue
            self.at, self.scope = what, rows.kinds
            self.unknown: set[str] = set()
            value = self.constraint()
            if self.unknown:
                rows.late.append(value.bool())
            else:
                rows = Rows(rows.df.where(F.expr(value.bool())), rows.kinds, rows.maybe, rows.late)
        self.at = end
        self.take("}")
        if rows.late:
            ready = [f for f in rows.late if all(n in rows.kinds for n in re.findall(r"`(\w+)`", f))]
            for f in ready:
                rows.df = rows.df.where(F.expr(f))
            rows.late = [f for f in rows.late if f not in ready]
        return rows

    def constraint(self) -> Value:
        if self.peek() == "(":
            self.take()
            out = self.expression()
            self.take(")")
            return out
        return self.atom()

    def skip_expression(self) -> None:
        if self.peek() != "(":
            self.take()
        depth = 0
        while True:
            t = self.take()
            depth += (t == "(") - (t == ")")
            if not depth:
                return

    def union(self, a: Rows, b: Rows) -> Rows:
        for n in set(a.kinds) & set(b.kinds):
            if a.kinds[n] != b.kinds[n]:
                a, b = self.as_terms(a, [n]), self.as_terms(b, [n])
        kinds = a.kinds | b.kinds
        maybe = a.maybe | b.maybe | (set(a.kinds) ^ set(b.kinds))
        return Rows(a.df.unionByName(b.df, allowMissingColumns=True).select(*kinds), kinds, maybe, a.late + b.late)

    def values(self) -> Rows:
        names = []
        if self.peek() == "(":
            self.take()
            while self.peek() != ")":
                names.append(self.take()[1:])
            self.take(")")
            many = True
        else:
            names, many = [self.take()[1:]], False
        self.take("{")
        rows = []
        while self.peek() != "}":
            if many:
                self.take("(")
            rows.append(tuple(None if self.took("UNDEF") else self.term() for _ in names))
            if many:
                self.take(")")
        self.take("}")
        df = self.data.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
        return Rows(df, dict.fromkeys(names, "term"), {n for i, n in enumerate(names) if any(r[i] is None for r in rows)})

    # --- expressions
    def expression(self) -> Value:
        left = self.conjunction()
        while self.peek() == "||":
            self.take()
            left = Value(f"({left.bool()} OR {self.conjunction().bool()})", "bool")
        return left

    def conjunction(self) -> Value:
        left = self.relation()
        while self.peek() == "&&":
            self.take()
            left = Value(f"({left.bool()} AND {self.relation().bool()})", "bool")
        return left

    def compared(self, a: Value, op: str, b: Value) -> str:
        op = "<>" if op == "!=" else op
        if "bool" in (a.kind, b.kind) and op in ("=", "<>"):
            return f"({a.bool()} {op} {b.bool()})"
        if "num" in (a.kind, b.kind):
            return f"({a.num()} {op} {b.num()})"
        if a.kind == b.kind == "term" and op in ("=", "<>"):
            return f"(coalesce({a.num()} {op} {b.num()}, {a.sql} {op} {b.sql}))"
        if a.kind == b.kind == "term":
            return f"(coalesce({a.num()} {op} {b.num()}, {a.str()} {op} {b.str()}))"
        return f"({a.str()} {op} {b.str()})"

    def relation(self) -> Value:
        left = self.sum()
        t = self.peek()
        if t in ("=", "!=", "<", ">", "<=", ">="):
            self.take()
            return Value(self.compared(left, t, self.sum()), "bool")
        no = self.took("NOT", "IN")
        if no or self.took("IN"):
            self.take("(")
            tests = []
            while self.peek() != ")":
                tests.append(self.compared(left, "=", self.expression()))
                if self.peek() == ",":
                    self.take()
            self.take(")")
            found = f"({' OR '.join(tests) or 'FALSE'})"
            return Value(f"(NOT {found})" if no else found, "bool")
        return left

    def sum(self) -> Value:
        left = self.product()
        while self.peek() in ("+", "-"):
            left = Value(f"({left.num()} {self.take()} {self.product().num()})", "num")
        return left

    def product(self) -> Value:
        left = self.unary()
        while self.peek() in ("*", "/"):
            op = self.take()
            right = self.unary().num()
            left = Value(f"({left.num()} / nullif({right}, 0D))" if op == "/" else f"({left.num()} * {right})", "num")
        return left

    def unary(self) -> Value:
        if self.peek() == "!":
            self.take()
            return Value(f"(NOT {self.unary().bool()})", "bool")
        if self.peek() == "-":
            self.take()
            return Value(f"(- {self.unary().num()})", "num")
        return self.atom()

    def atom(self) -> Value:
        t = self.peek()
        if t == "(":
            self.take()
            out = self.expression()
            self.take(")")
            return out
        if t[:1] in ("?", "$"):
            return self.variable(self.take()[1:])
        if t[:1].isdigit():
            return Value(f"{float(self.take())!r}D", "num")
        if re.fullmatch(r"[A-Za-z_]\w*", t) and self.peek(1) == "(":
            return self.call(self.take().upper())
        if t.lower() in ("true", "false"):
            return Value(self.take().upper(), "bool")
        if t[:1] in "\"'" and self.peek(1) != "^^" and not self.peek(1).startswith("@"):
            text = re.sub(r"\\(.)", r"\1", self.take()[1:-1])
            return Value(_quote(text), "str")
        found = self.term()
        if self.peek() == "(" and found.startswith(f"<{XSD}"):
            kind = found[len(XSD) + 1 : -1]
            (arg,) = self.arguments()
            if kind in ("integer", "int", "long"):
                return Value(f"CAST(try_cast({arg.str()} AS DOUBLE) AS BIGINT)", "num")
            if kind in ("double", "decimal", "float"):
                return Value(f"try_cast({arg.str()} AS DOUBLE)", "num")
            return Value(arg.str(), "str") if kind == "string" else Value(f"concat('\"', {arg.str()}, '\"^^{found}')")
        return Value(_quote(found))

    def variable(self, name: str) -> Value:
        if name not in self.scope:
            if not hasattr(self, "unknown"):
                raise SparqlFault(f"?{name} isn't bound here")
            self.unknown.add(name)
        return Value(f"`{name}`", self.scope.get(name, "term"))

    def arguments(self) -> list[Value]:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.expression())
            if self.peek() == ",":
                self.take()
        self.take(")")
        return out

    def aggregate(self, name: str) -> Value:
        if self.aggregates is None:
            raise SparqlFault(f"{name} outside SELECT and HAVING")
        self.take("(")
        distinct = "DISTINCT " if self.took("DISTINCT") else ""
        separator = " "
        if self.peek() == "*":
            self.take()
            sql, kind = "CAST(count(1) AS DOUBLE)", "num"
        else:
            x = self.expression()
            if self.peek() == ";":
                self.take()
                self.take("SEPARATOR")
                self.take("=")
                separator = self.take()[1:-1]
            if name == "COUNT":
                sql, kind = f"CAST(count({distinct}{x.sql}) AS DOUBLE)", "num"
            elif name in ("SUM", "AVG"):
                sql, kind = f"coalesce({name.lower()}({distinct}{x.num()}), 0D)", "num"
            elif name in ("MIN", "MAX"):
                # numbers before texts, each in their order
                pick = f"{name.lower()}_by({x.sql}, struct({x.num() if x.kind != 'str' else 'CAST(NULL AS DOUBLE)'} IS NULL, {x.num() if x.kind != 'str' else '0D'}, {x.str()}))"
                sql, kind = (f"{name.lower()}({x.sql})" if x.kind == "num" else pick), x.kind
            elif name == "SAMPLE":
                sql, kind = f"min({x.sql})", x.kind
            else:
                values = f"collect_set({x.str()})" if distinct else f"collect_list({x.str()})"
                sql, kind = f"array_join(array_sort({values}), {_quote(separator)})", "str"
        self.take(")")
        slot = f"_a{len(self.aggregates)}"
        self.aggregates[slot] = (sql, kind)
        return Value(f"`{slot}`", kind)

    def call(self, name: str) -> Value:
        if name in _AGGREGATES:
            return self.aggregate(name)
        if name == "BOUND":
            self.take("(")
            v = self.variable(self.take()[1:])
            self.take(")")
            return Value(f"({v.sql} IS NOT NULL)", "bool")
        a = self.arguments()
        s = [x.str() for x in a] if name not in ("IF", "COALESCE", "NOW", "RAND", "UUID", "STRUUID") else []
        if name in _DIGESTS:
            return Value(_DIGESTS[name].format(s[0]), "str")
        if name in _PARTS:
            # the time as written, whatever its zone
            local = f"regexp_replace({s[0]}, '(Z|[+-][0-9][0-9]:[0-9][0-9])$', '')"
            return Value(f"CAST({_PARTS[name]}(CAST(replace({local}, 'T', ' ') AS TIMESTAMP_NTZ)) AS DOUBLE)", "num")
        simple = {
            "STR": ("str", "{0}"), "STRLEN": ("num", "CAST(length({0}) AS DOUBLE)"), "UCASE": ("str", "upper({0})"), "LCASE": ("str", "lower({0})"),
            "CONTAINS": ("bool", "contains({0}, {1})"), "STRSTARTS": ("bool", "startswith({0}, {1})"), "STRENDS": ("bool", "endswith({0}, {1})"),
            "STRBEFORE": ("str", "(CASE WHEN contains({0}, {1}) THEN substring({0}, 1, instr({0}, {1}) - 1) ELSE '' END)"),
            "STRAFTER": ("str", "(CASE WHEN contains({0}, {1}) THEN substring({0}, instr({0}, {1}) + length({1})) ELSE '' END)"),
            "ENCODE_FOR_URI": ("str", "replace(replace(url_encode({0}), '+', '%20'), '*', '%2A')"),
            "TZ": ("str", "regexp_extract({0}, '(Z|[+-][0-9][0-9]:[0-9][0-9])$', 1)"),
        }
        if name in simple:
            kind, form = simple[name]
            return Value(form.format(*s), kind)
        if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
            return Value(f"CAST({name.lower()}({a[0].num()}) AS DOUBLE)" if name != "ROUND" else f"floor({a[0].num()} + 0.5D) * 1D", "num")
        if name == "CONCAT":
            return Value(f"concat({', '.join(s)})", "str")
        if name == "SUBSTR":
            return Value(f"substring({s[0]}, CAST({a[1].num()} AS INT){f', CAST({a[2].num()} AS INT)' if len(a) > 2 else ''})", "str")
        if name in ("REGEX", "REPLACE"):
            flags = a[2 if name == "REGEX" else 3].sql if len(a) > (2 if name == "REGEX" else 3) else None
            pattern = f"concat('(?', {flags}, ')', {s[1]})" if flags else s[1]
            return Value(f"rlike({s[0]}, {pattern})", "bool") if name == "REGEX" else Value(f"regexp_replace({s[0]}, {pattern}, {s[2]})", "str")
        if name == "IF":
            same = a[1].kind if a[1].kind == a[2].kind else "term"
            x, y = (a[1].sql, a[2].sql) if same == a[1].kind == a[2].kind else (a[1].term(), a[2].term())
            return Value(f"(CASE WHEN {a[0].bool()} THEN {x} ELSE {y} END)", same)
        if name == "COALESCE":
            same = len({x.kind for x in a}) == 1
            return Value(f"coalesce({', '.join(x.sql if same else x.term() for x in a)})", a[0].kind if same else "term")
        if name in ("ISIRI", "ISURI"):
            return Value(f"(startswith({a[0].term()}, '<') AND NOT startswith({a[0].term()}, '<<'))", "bool")
        if name == "ISBLANK":
            return Value(f"startswith({a[0].term()}, '_:')", "bool")
        if name == "ISLITERAL":
            return Value(f"startswith({a[0].term()}, '\"')", "bool")
        if name == "ISNUMERIC":
            return Value(f"({a[0].num() if a[0].kind != 'str' else 'NULL'} IS NOT NULL)", "bool")
        if name == "LANG":
            return Value(f"regexp_extract({a[0].term()}, '\"@([A-Za-z0-9-]+)$', 1)", "str")
        if name == "LANGMATCHES":
            return Value(f"(CASE WHEN {s[1]} = '*' THEN {s[0]} <> '' ELSE lower({s[0]}) = lower({s[1]}) OR startswith(lower({s[0]}), concat(lower({s[1]}), '-')) END)", "bool")
        if name == "DATATYPE":
            t = a[0].term()
            return Value(f"(CASE WHEN rlike({t}, '\"@[A-Za-z0-9-]+$') THEN '<{RDF}langString>' WHEN contains({t}, '\"^^<') THEN regexp_extract({t}, '(<[^<>]*>)$', 1) WHEN startswith({t}, '\"') THEN '<{XSD}string>' END)")
        if name in ("IRI", "URI"):
            return Value(f"concat('<', {s[0]}, '>')")
        if name == "BNODE":
            return Value(f"concat('_:b', {f'md5({s[0]})' if s else 'replace(uuid(), chr(45), chr(95))'})")
        if name == "STRDT":
            return Value(f"concat('\"', {s[0]}, '\"^^', {a[1].term()})")
        if name == "STRLANG":
            return Value(f"concat('\"', {s[0]}, '\"@', {s[1]})")
        if name == "SAMETERM":
            return Value(f"({a[0].term()} = {a[1].term()})", "bool")
        if name == "TIMEZONE":
            zone = f"regexp_extract({s[0]}, '(Z|[+-][0-9][0-9]:[0-9][0-9])$', 1)"
            text = f"CASE WHEN {zone} = 'Z' THEN 'PT0S' WHEN {zone} <> '' THEN concat(CASE WHEN startswith({zone}, '-') THEN '-' ELSE '' END, 'PT', CAST(CAST(substring({zone}, 2, 2) AS INT) AS STRING), 'H', CASE WHEN substring({zone}, 5, 2) = '00' THEN '' ELSE concat(CAST(CAST(substring({zone}, 5, 2) AS INT) AS STRING), 'M') END) END"
            return Value(f"concat('\"', {text}, '\"^^<{XSD}dayTimeDuration>')")
        fixed = {"NOW": (f"concat('\"', date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSXXX\"), '\"^^<{XSD}dateTime>')", "term"), "RAND": ("rand()", "num"), "UUID": ("concat('<urn:uuid:', uuid(), '>')", "term"), "STRUUID": ("uuid()", "str")}
        if name in fixed:
            return Value(*fixed[name])
        raise SparqlFault(f"unknown function {name}")

    # --- query forms
    def select(self) -> Rows:
        self.take("SELECT")
        distinct = self.took("DISTINCT") or self.took("REDUCED")
        start = self.at
        depth = 0
        while not (depth == 0 and (self.peek() == "{" or self.word() in ("WHERE", "FROM"))):
            depth += (self.peek() == "(") - (self.peek() == ")")
            self.take()
        self.dataset_clause()
        self.took("WHERE")
        items_at = start
        rows = self.group()
        after = self.at
        self.aggregates, self.scope = {}, dict(rows.kinds)
        df, keys = rows.df, []
        if hasattr(self, "unknown"):
            del self.unknown
        if self.took("GROUP", "BY"):
            while self.peek()[:1] in ("?", "$", "(") or re.fullmatch(r"[A-Za-z]\w*", self.peek()) and self.peek(1) == "(" and self.word() != "HAVING":
                if self.peek()[:1] in ("?", "$"):
                    keys.append(self.take()[1:])
                    continue
                wrapped = self.peek() == "("
                if wrapped:
                    self.take()
                value = self.expression()
                name = self.take()[1:] if self.took("AS") else self.new()
                if wrapped:
                    self.take(")")
                df, self.scope[name] = df.withColumn(name, F.expr(value.sql)), value.kind
                keys.append(name)
            after = self.at
        # the projection, read with the group's scope
        self.at, items = items_at, []
        while self.peek()[:1] in ("?", "$", "*", "("):
            if self.peek() == "*":
                self.take()
                items += [(n, Value(f"`{n}`", k), True) for n, k in self.scope.items() if not n.startswith("_")]
            elif self.peek() == "(":
                self.take()
                value = self.expression()
                self.take("AS")
                name = self.take()[1:]
                self.take(")")
                items.append((name, value, False))
                self.scope = self.scope | {name: value.kind}
            else:
                name = self.take()[1:]
                # a variable that the pattern never binds is null everywhere
                items.append((name, self.variable(name) if name in self.scope else Value("CAST(NULL AS STRING)"), True))
        self.at = after
        having = []
        if self.took("HAVING"):
            while self.peek() == "(":
                having.append(self.constraint())
        order = []
        if self.took("ORDER", "BY"):
            while self.peek() and self.peek() != "}" and self.word() not in ("LIMIT", "OFFSET", "VALUES"):
                down = self.word() == "DESC"
                if self.word() in ("ASC", "DESC"):
                    self.take()
                order.append((self.constraint() if self.peek() == "(" else self.atom(), down))
        limit = offset = None
        while self.word() in ("LIMIT", "OFFSET"):
            if self.take().upper() == "LIMIT":
                limit = int(self.take())
            else:
                offset = int(self.take())
        late = self.values() if self.took("VALUES") else None
        if late is not None:
            df = self.join(Rows(df, rows.kinds, rows.maybe), late).df
        if keys or self.aggregates:
            slots = [F.expr(sql).alias(n) for n, (sql, _) in self.aggregates.items()] or [F.count(F.lit(1)).alias("_n")]
            df = df.groupBy(*keys).agg(*slots)
        self.aggregates = None
        for name, value, plain in items:
            if not plain:
                df = df.withColumn(name, F.expr(value.sql))
        for h in having:
            df = df.where(F.expr(h.bool()))
        sorts = []
        for value, down in order:
            for part in [F.expr(value.num()), F.expr(value.str())] if value.kind == "term" else [F.expr(value.sql)]:
                sorts.append(part.desc() if down else part.asc())
        shown = [F.expr(v.sql).alias(n) if plain else F.col(n) for n, v, plain in items]
        if distinct:
            df = df.select(*shown).distinct()
            df = df.orderBy(*sorts) if sorts else df
        else:
            df = (df.orderBy(*sorts) if sorts else df).select(*shown)
        df = df.offset(offset) if offset is not None else df
        df = df.limit(limit) if limit is not None else df
        names = {n for n, *_ in items}
        return Rows(df, {n: v.kind for n, v, _ in items}, (rows.maybe & names) | {n for n, _, plain in items if not plain})

    def dataset_clause(self) -> None:
        """FROM merges named graphs into the default one; FROM NAMED restricts the named graphs."""
        default, named = [], []
        while self.took("FROM"):
            (named if self.took("NAMED") else default).append(self.term())
        if default or named:
            merged = self.data.quads.where(F.col("g").isin(default)).select(F.lit(None).cast("string").alias("g"), "s", "p", "o").distinct()
            self.quads = merged.unionByName(self.data.quads.where(F.col("g").isin(named)))

    def run(self) -> DataFrame:
        self.prologue()
        form = self.word()
        if form == "SELECT":
            rows = self.select()
            return rows.df.select(*[F.expr(Value(f"`{n}`", k).str() if k == "term" else f"`{n}`").alias(n) for n, k in rows.kinds.items()])
        if form == "ASK":
            self.take()
            self.dataset_clause()
            self.took("WHERE")
            return self.group().df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
        if form == "CONSTRUCT":
            self.take()
            template = self.template()
            self.dataset_clause()
            self.took("WHERE")
            return self.filled(template, self.group()).select("s", "p", "o").distinct()
        if form == "DESCRIBE":
            self.take()
            wanted = []
            while self.peek() and self.peek() != "{" and self.word() not in ("WHERE", "FROM"):
                wanted.append(self.term())
            self.dataset_clause()
            found = None
            constants = [t for t in wanted if not t.startswith("?")]
            ids = self.data.spark.createDataFrame([(t,) for t in constants], "_t string")
            if self.took("WHERE") or self.peek() == "{":
                found = self.group()
                for t in wanted:
                    if t.startswith("?"):
                        ids = ids.unionByName(found.df.select(F.col(t[1:]).alias("_t")))
            t = self.triples()
            return t.join(ids.distinct(), t["s"] == F.col("_t"), "left_semi").select("s", "p", "o")
        raise SparqlFault(f"no query form: {form!r}")

    def template(self) -> list[tuple[str, str, str, str | None]]:
        """(s, p, o, graph) patterns in braces; GRAPH blocks inside name the graph."""
        self.take("{")
        out = []
        while self.peek() != "}":
            if self.took("GRAPH"):
                graph = self.term()
                out += [(s, p, o, graph) for s, p, o, _ in self.template()]
            else:
                for s, verb, o in self.block():
                    if verb[0] != "iri":
                        raise SparqlFault("a path in a template")
                    out.append((s, verb[1], o, None))
            if self.peek() == ".":
                self.take()
        self.take("}")
        return out

    def filled(self, template, rows: Rows) -> DataFrame:
        """Quads that the template gives; those with an unbound part are left out."""
        def part(t):
            if t is None:
                return F.lit(None).cast("string")
            if t.startswith("<<") and "?" in t:
                return F.concat(F.lit(f"<<{_UNIT}"), *[x for inner in t.split(_UNIT)[1:-1] for x in (part(inner), F.lit(_UNIT))], F.lit(">>"))
            if not t.startswith("?"):
                return F.lit(t)
            if t.startswith("?_n"):
                return F.concat(F.lit(f"_:{t[3:]}"), F.col("_row"))
            return F.expr(Value(f"`{t[1:]}`", rows.kinds[t[1:]]).term())

        df = rows.df
        if any(str(t).startswith("?_n") for q in template for t in q):
            # a blank node of the template is another one for each solution
            names = list(rows.kinds)
            df = df.withColumn("_row", F.substring(F.sha2(F.concat_ws(_UNIT, *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]), 256), 1, 16))
        out = None
        for s, p, o, g in template:
            some = df.select(part(g).alias("g"), part(s).alias("s"), part(p).alias("p"), part(o).alias("o")).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
            out = some if out is None else out.unionByName(some)
        return out if out is not None else self.data.quads.limit(0)

    # --- updates
    def updated(self) -> Dataset:
        data = self.data
        while True:
            self.prologue()
            if not self.peek():
                return data
            self.data, self.quads, self.graph = data, data.quads, None
            data = Dataset(self.changed(), data.services)
            if self.peek() == ";":
                self.take()

    def _graph_ref(self) -> str | None:
        """DEFAULT gives None, GRAPH x the term."""
        if self.took("DEFAULT"):
            return None
        self.took("GRAPH")
        return self.term()

    def _of(self, graph: str | None):
        return F.col("g").isNull() if graph is None else F.col("g").eqNullSafe(F.lit(graph))

    def changed(self) -> DataFrame:
        q = self.data.quads
        form = self.word()
        if form in ("INSERT", "DELETE") and self.word(1) == "DATA":
            self.at += 2
            rows = self.filled(self.template(), self.unit())
            return self.plus(q, rows) if form == "INSERT" else self.minus(q, rows)
        if form in ("WITH", "INSERT", "DELETE"):
            graph = None
            if self.took("WITH"):
                graph = self.term()
            gone = new = []
            if self.took("DELETE"):
                if self.took("WHERE"):
                    at = self.at
                    gone = self.template()
                    self.at, self.graph = at, graph
                    found = self.group()
                    return self.minus(q, self.filled(gone, found))
                gone = self.template()
            if self.took("INSERT"):
                new = self.template()
            self.dataset_clause()
            self.take("WHERE")
            self.graph = graph
            found = self.group()
            here = lambda t: [(s, p, o, g or graph) for s, p, o, g in t]
            out = self.minus(q, self.filled(here(gone), found)) if gone else q
            return self.plus(out, self.filled(here(new), found)) if new else out
        if form in ("CLEAR", "DROP", "CREATE"):
            self.take()
            self.took("SILENT")
            if form == "CREATE":  # graphs are there by their triples
                self._graph_ref()
                return q
            if self.took("ALL"):
                return q.limit(0)
            if self.took("NAMED"):
                return q.where("g IS NULL")
            return q.where(~self._of(self._graph_ref()))
        if form in ("COPY", "MOVE", "ADD"):
            self.take()
            self.took("SILENT")
            source = self._graph_ref()
            self.take("TO")
            target = self._graph_ref()
            if source == target:
                return q
            moved = q.where(self._of(source)).withColumn("g", F.lit(target).cast("string"))
            rest = q if form == "ADD" else q.where(~self._of(target))
            rest = rest.where(~self._of(source)) if form == "MOVE" else rest
            return self.plus(rest, moved)
        raise SparqlFault(f"no update: {form!r}")

    def plus(self, q: DataFrame, rows: DataFrame) -> DataFrame:
        return q.unionByName(rows.select(*q.columns)).distinct()

    def minus(self, q: DataFrame, rows: DataFrame) -> DataFrame:
        gone = rows.select(*[F.col(c).alias(f"_{c}") for c in q.columns]).distinct()
        return q.join(gone, [q[c].eqNullSafe(gone[f"_{c}"]) for c in q.columns], "left_anti")
