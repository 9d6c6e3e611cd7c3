"""A pipe-style query language over the property graph, parsed straight into DataFrame plans.

    MATCH (:order) WHERE value > 100000 AND NOT id LIKE '%9'
      |> TRAVERSE -[:PLACED_BY]->{1,2} |> RANK BY value DESC |> LIMIT 10 |> RETURN id, score

Stages: MATCH (:Label) or MATCH (), WHERE, TRAVERSE -[:REL]->{m,n} (REL * for
any), EXPAND -[:REL]-> (neighbours beside the rows themselves), RANK BY property
[ASC|DESC], RANK BY EMBEDDING $vector, RANK BY TEXT 'words', RANK BY DISTANCE TO
'id' (hops, directions ignored), RANK BY MENTIONS REL (edges that point at a row),
MMR k LAMBDA x, PROPAGATE NOISY_OR|CASCADE -[:REL]-> WEIGHT w HOPS n, WINDOW n
unit agg OF property, AS OF t or VALID AS OF t, BUDGET n (more rows are an error),
LIMIT k, RETURN columns. LET name = pipeline; binds a result, FROM a JOIN b
intersects bindings by id and keeps the first one's order, FUSE a, b ranks them
together by reciprocal ranks. EXPLAIN before a query gives its plan. $name is a
bound parameter.

Rows are (id, score, ord) and, as long as no stage has moved to other nodes, the
nodes' properties, so filters and ranks after MATCH are in the scan's own rows;
after a move one join brings them back. ord is the order that LIMIT cuts, ids are
distinct. Comparisons with a missing value keep nothing, as in SQL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.graph import held, noisy_or, traverse

_TOKEN = re.compile(r"\s*(?:(\|>)|('(?:[^']|'')*')|(-?\d+(?:\.\d+)?)|(\$?[A-Za-z_][\w.]*)|(<=|>=|<>|->|[-=<>(){}\[\]:,;*]))")
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


class SyntaxFault(ValueError):
    """The query can't be parsed."""


def lex(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxFault(f"unexpected {text[at:at + 20]!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


@dataclass(frozen=True)
class Stage:
    kind: str
    args: dict = field(default_factory=dict)

    def show(self) -> str:
        a = self.args
        return {
            "match": lambda: f"MATCH ({':' + a['label'] if a['label'] else ''})", "where": lambda: f"WHERE {a['text']}",
            "traverse": lambda: f"TRAVERSE -[:{a['rel']}]->{{{a['least']},{a['most']}}}", "rank": lambda: f"RANK BY {a['by']} {'DESC' if a['desc'] else 'ASC'}",
            "limit": lambda: f"LIMIT {a['k']}", "return": lambda: "RETURN " + ", ".join(a["columns"]), "from": lambda: "FROM " + " JOIN ".join(a["names"]),
            "expand": lambda: f"EXPAND -[:{a['rel']}]->", "embed": lambda: f"RANK BY EMBEDDING {a['v']}", "text": lambda: f"RANK BY TEXT '{a['text']}'", "distance": lambda: f"RANK BY DISTANCE TO '{a['id']}'",
            "mentions": lambda: f"RANK BY MENTIONS {a['rel']}", "mmr": lambda: f"MMR {a['k']} LAMBDA {a['lam']}", "propagate": lambda: f"PROPAGATE {a['how']} -[:{a['rel']}]-> WEIGHT {a['w']} HOPS {a['hops']}",
            "fuse": lambda: "FUSE " + ", ".join(a["names"]), "budget": lambda: f"BUDGET {a['n']}",
            "asof": lambda: f"AS OF {a['t']}", "window": lambda: f"WINDOW {a['n']} {a['unit']} {a['agg']} OF {a['of']}",
        }[self.kind]()


class Parser:
    def __init__(self, text: str, params: dict | None = None):
        self.tokens, self.at, self.params = lex(text), 0, params or {}

    def peek(self, offset: int = 0) -> str:
        return self.tokens[self.at + offset] if self.at + offset < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        token = self.peek()
        if not token or wanted and token.upper() not in wanted:
            raise SyntaxFault(f"expected {' or '.join(wanted) or 'more'}, got {token or 'the end'!r}")
        self.at += 1
        return token

    def word(self, *names: str) -> bool:
        return self.peek().upper() in names

    def statement(self) -> tuple[dict[str, list[Stage]], list[Stage]]:
        lets: dict[str, list[Stage]] = {}
        while self.word("LET"):
            self.take()
            name = self.take()
            self.take("=")
            lets[name] = self.pipeline()
            self.take(";")
        out = self.pipeline()
        if self.peek():
            raise SyntaxFault(f"unexpected {self.peek()!r}")
        return lets, out

    def pipeline(self) -> list[Stage]:
        stages = [self.stage()]
        while self.word("|>", "WHERE"):
            if self.peek() == "|>":
                self.take()
            stages.append(self.stage())
        return stages

    def stage(self) -> Stage:
        kind = self.take("MATCH", "FROM", "WHERE", "TRAVERSE", "EXPAND", "RANK", "MMR", "PROPAGATE", "FUSE", "BUDGET", "LIMIT", "RETURN", "VALID", "AS", "WINDOW").upper()
        if kind == "MATCH":
            self.take("(")
            label = None
            if self.peek() == ":":
                self.take()
                label = self.take()
            self.take(")")
            return Stage("match", {"label": label})
        if kind == "FROM":
            names = [self.take()]
            while self.word("JOIN"):
                self.take()
                names.append(self.take())
            return Stage("from", {"names": names})
        if kind == "WHERE":
            start = self.at
            test = self.either()
            return Stage("where", {"test": test, "text": " ".join(self.tokens[start : self.at])})
        if kind == "EXPAND":
            return Stage("expand", {"rel": self.relation()})
        if kind == "MMR":
            k = int(self.literal())
            self.take("LAMBDA")
            return Stage("mmr", {"k": k, "lam": float(self.literal())})
        if kind == "PROPAGATE":
            how, rel = self.take("NOISY_OR", "CASCADE").upper(), self.relation()
            self.take("WEIGHT")
            w = float(self.literal())
            self.take("HOPS")
            return Stage("propagate", {"how": how, "rel": rel, "w": w, "hops": int(self.literal())})
        if kind == "FUSE":
            names = [self.take()]
            while self.peek() == ",":
                self.take()
                names.append(self.take())
            return Stage("fuse", {"names": names})
        if kind == "BUDGET":
            return Stage("budget", {"n": int(self.literal())})
        if kind == "VALID":
            self.take("AS")
            kind = "AS"
        if kind == "RANK" and self.peek(1).upper() in ("EMBEDDING", "TEXT", "DISTANCE", "MENTIONS"):
            self.take("BY")
            by = self.take().upper()
            if by == "EMBEDDING":
                return Stage("embed", {"v": self.literal()})
            if by == "TEXT":
                return Stage("text", {"text": self.literal()})
            if by == "DISTANCE":
                self.take("TO")
                return Stage("distance", {"id": self.literal()})
            return Stage("mentions", {"rel": self.take()})
        if kind == "TRAVERSE":
            rel = self.relation()
            least = most = 1
            if self.peek() == "{":
                self.take()
                least = int(self.take())
                self.take(",")
                most = int(self.take())
                self.take("}")
            return Stage("traverse", {"rel": rel, "least": least, "most": most})
        if kind == "RANK":
            self.take("BY")
            by = self.take()
            desc = not self.word("ASC")
            if self.word("ASC", "DESC"):
                self.take()
            return Stage("rank", {"by": by, "desc": desc})
        if kind == "LIMIT":
            return Stage("limit", {"k": int(self.literal())})
        if kind == "AS":
            self.take("OF")
            return Stage("asof", {"t": self.literal()})
        if kind == "WINDOW":
            n, unit, agg = int(self.take()), self.take().lower(), self.take().lower()
            if unit not in _UNITS or agg not in ("mean", "sum", "min", "max", "count"):
                raise SyntaxFault(f"unknown window {unit} {agg}")
            self.take("OF")
            return Stage("window", {"n": n, "unit": unit, "agg": agg, "of": self.take()})
        columns = [self.take()]
        while self.peek() == ",":
            self.take()
            columns.append(self.take())
        return Stage("return", {"columns": columns})

    def relation(self) -> str:
        for t in ("-", "[", ":"):
            self.take(t)
        rel = self.take()
        for t in ("]", "->"):
            self.take(t)
        return rel

    # predicates become columns at once; three-valued logic comes with them
    def either(self) -> Column:
        out = self.both()
        while self.word("OR"):
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.word("AND"):
            self.take()
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.word("NOT"):
            self.take()
            return ~self.one()
        if self.peek() == "(":
            self.take()
            out = self.either()
            self.take(")")
            return out
        c = F.col(self.take())
        op = self.take("=", "<>", "<", ">", "<=", ">=", "IN", "BETWEEN", "LIKE", "CONTAINS", "STARTS", "IS").upper()
        if op == "IS":
            no = self.word("NOT")
            if no:
                self.take()
            self.take("NULL")
            return c.isNotNull() if no else c.isNull()
        if op == "IN":
            self.take("(")
            values = [self.literal()]
            while self.peek() == ",":
                self.take()
                values.append(self.literal())
            self.take(")")
            return c.isin(values)
        if op == "STARTS":
            self.take("WITH")
            return c.startswith(self.literal())
        value = self.literal()
        if op == "BETWEEN":
            self.take("AND")
            return c.between(value, self.literal())
        return {"=": lambda: c == value, "<>": lambda: c != value, "<": lambda: c < value, ">": lambda: c > value, "<=": lambda: c <= value, ">=": lambda: c >= value, "LIKE": lambda: c.like(value), "CONTAINS": lambda: c.contains(value)}[op]()

    def literal(self):
        token = self.take()
        if token[0] == "$":
            if token[1:] not in self.params:
                raise SyntaxFault(f"no parameter {token}")
            return self.params[token[1:]]
        if token[0] == "'":
            return token[1:-1].replace("''", "'")
        if re.fullmatch(r"-?\d+(\.\d+)?", token):
            return float(token) if "." in token else int(token)
        if token.upper() in ("TRUE", "FALSE"):
            return token.upper() == "TRUE"
        raise SyntaxFault(f"not a literal: {token!r}")


def show(text: str, params: dict | None = None) -> str:
    """The canonical text of a query."""
    lets, out = Parser(text, params).statement()
    line = lambda p: " |> ".join(s.show() for s in p)
    return " ".join([*(f"LET {n} = {line(p)};" for n, p in lets.items()), line(out)])


def run(text: str, nodes: DataFrame, edges: DataFrame, params: dict | None = None) -> DataFrame:
    """The result of a query over nodes (id, label, properties..) and edges (src, dst, rel). Embeddings and texts are the properties of that name."""
    explain = re.match(r"\s*EXPLAIN\b", text, re.I)
    lets, out = Parser(text[explain.end() :] if explain else text, params).statement()
    bound: dict[str, DataFrame] = {}
    for name, stages in lets.items():
        bound[name] = _apply(stages, nodes, edges, bound)
    found = _apply(out, nodes, edges, bound)
    if not explain:
        return found
    spark = nodes.sparkSession
    plan = found._jdf.queryExecution().toString()
    return spark.createDataFrame([(show(text[explain.end() :], params), plan)], "query string, plan string")


_ROW = ("id", "score", "ord")


def _apply(stages: list[Stage], nodes: DataFrame, edges: DataFrame, bound: dict[str, DataFrame]) -> DataFrame:
    rows: DataFrame | None = None
    props = [c for c in nodes.columns if c not in _ROW]
    order = lambda first: F.struct(first.cast("double").alias("o"), F.col("id").alias("id"))
    along = lambda rel: edges if rel == "*" else edges.where(F.col("rel") == rel)

    def full() -> DataFrame:
        """rows with the nodes' properties, which the rows may still have."""
        return rows if all(c in rows.columns for c in props) else rows.select(*_ROW).join(nodes, "id")

    def scored(df: DataFrame, score: Column, first: Column) -> DataFrame:
        keep = [c for c in df.columns if c not in _ROW]
        return df.select("id", score.cast("double").alias("score"), *keep).where("score IS NOT NULL").withColumn("ord", order(first))

    for stage in stages:
        a = stage.args
        if stage.kind == "match":
            found = nodes if a["label"] is None else nodes.where(F.col("label") == a["label"])
            rows = found.select("id", F.lit(None).cast("double").alias("score"), order(F.lit(0.0)).alias("ord"), *props)
        elif stage.kind == "from":
            first, *others = (bound[n] for n in a["names"])
            for other in others:
                first = first.join(other.select("id"), "id", "left_semi")
            rows = first
        elif stage.kind == "fuse":
            lists = [bound[n].select("id", (F.row_number().over(Window.orderBy("ord")) - 1).alias("rank")) for n in a["names"]]
            rows = scored(retrieval.rrf(lists).withColumn("ord", F.lit(0)), F.col("score"), -F.col("score"))
        elif rows is None:
            raise SyntaxFault(f"{stage.kind} needs rows before it")
        elif stage.kind == "where":
            rows = full().where(a["test"])
        elif stage.kind == "asof":
            live = (F.coalesce("valid_from", F.lit(0)) <= a["t"]) & (F.col("valid_until").isNull() | (F.lit(a["t"]) < F.col("valid_until")))
            rows = full().where(live)
        elif stage.kind == "traverse":
            hit = traverse(along(a["rel"]).select("src", "dst"), rows.select("id"), a["least"], a["most"])
            rows = hit.select("id", F.lit(None).cast("double").alias("score"), order(F.col("depth")).alias("ord"))
        elif stage.kind == "expand":
            near = along(a["rel"]).join(rows.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), F.lit(1).alias("d"))
            both = rows.select("id", F.lit(0).alias("d")).unionByName(near).groupBy("id").agg(F.min("d").alias("d"))
            rows = both.select("id", F.lit(None).cast("double").alias("score"), order(F.col("d")).alias("ord"))
        elif stage.kind == "propagate":
            e = along(a["rel"]).select("src", "dst", F.lit(a["w"]).alias("w"))
            seeds = rows.select("id", F.coalesce("score", F.lit(1.0)).alias("prior"))
            found = noisy_or(e, seeds, a["hops"]) if a["how"] == "NOISY_OR" else _cascade(e, seeds, a["hops"])
            rows = found.select("id", F.col("p").alias("score"), order(-F.col("p")).alias("ord"))
        elif stage.kind == "rank":
            value = F.col(a["by"]).cast("double")
            rows = scored(full(), value, -F.col("score") if a["desc"] else F.col("score"))
        elif stage.kind == "embed":
            near = retrieval.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in a["v"]]))
            rows = scored(full(), near, -F.col("score"))
        elif stage.kind == "text":
            best = retrieval.bm25(full().select(F.col("id").alias("doc_id"), "text"), re.findall(r"\w+", a["text"]))
            rows = best.select(F.col("doc_id").alias("id"), "score").withColumn("ord", order(-F.col("score")))
        elif stage.kind == "distance":
            both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            start = nodes.where(F.col("id") == a["id"]).select("id")
            far = traverse(both, start, 0, 1 << 30)
            rows = scored(rows.join(far, "id"), F.col("depth"), F.col("score")).drop("depth")
        elif stage.kind == "mentions":
            count = along(a["rel"]).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("_m"))
            rows = scored(rows.join(count, "id", "left"), F.coalesce("_m", F.lit(0)), -F.col("score")).drop("_m")
        elif stage.kind == "mmr":
            key = held(full().select("id", "embedding", "score").withColumn("vec_id", F.row_number().over(Window.orderBy("id")).cast("long")))
            picks = retrieval.mmr(key.select("vec_id", "embedding", "score"), a["lam"], a["k"])
            rows = key.join(picks, "vec_id").select("id", "score", order(F.col("pick")).alias("ord"))
        elif stage.kind == "window":
            width = a["n"] * _UNITS[a["unit"]]
            start = (F.floor(F.col("valid_from") / width) * width).cast("long")
            agg = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[a["agg"]](a["of"])
            hit = full().where("valid_from IS NOT NULL").groupBy(start.alias("b")).agg(agg.cast("double").alias("score"))
            rows = hit.select(F.col("b").cast("string").alias("id"), "score", F.col("b")).withColumn("ord", order(F.col("b"))).drop("b")
        elif stage.kind == "budget":
            n = rows.limit(a["n"] + 1).count()
            if n > a["n"]:
                raise ValueError(f"more than {a['n']} rows before the next stage")
        elif stage.kind == "limit":
            rows = rows.orderBy("ord").limit(a["k"])
        else:
            rows = full() if any(c not in rows.columns for c in a["columns"]) else rows
            rows = rows.select(*a["columns"], *(["ord"] if "ord" not in a["columns"] else []))
    return rows if any(s.kind == "return" for s in stages) else rows.select(*_ROW)


def _cascade(e: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, p): the strongest way to a node, the product of weights along it times the seed's value."""
    best = front = held(seeds.select("id", F.col("prior").alias("p")))
    for _ in range(hops):
        step = e.join(front, e["src"] == front["id"]).groupBy(F.col("dst").alias("id")).agg(F.max(F.col("w") * F.col("p")).alias("new"))
        front = held(step.join(best, "id", "left").where(F.col("p").isNull() | (F.col("new") > F.col("p"))).select("id", F.col("new").alias("p")))
        if not front.take(1):
            break
        best = held(best.unionByName(front).groupBy("id").agg(F.max("p").alias("p")))
    return best
