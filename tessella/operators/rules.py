"""Triples: basic graph patterns, class and property closure, rules with confidence, shape checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import held


def match(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Bindings of a basic graph pattern; terms that begin with ? are variables. Equal rows count once per match, as a bag."""
    out = None
    for s, p, o in patterns:
        rows, names = triples, {}
        for column, term in (("s", s), ("p", p), ("o", o)):
            if term.startswith("?"):
                if term in names:
                    rows = rows.where(F.col(names[term]) == F.col(column))
                names.setdefault(term, column)
            else:
                rows = rows.where(F.col(column) == term)
        rows = rows.select(*[F.col(c).alias(v[1:]) for v, c in names.items()])
        shared = [] if out is None else [c for c in rows.columns if c in out.columns]
        out = rows if out is None else out.join(rows, shared) if shared else out.crossJoin(rows)  # a pattern without shared variables is a product by definition
    return out


def closure(pairs: DataFrame, most: int = 64) -> DataFrame:
    """Transitive closure of (a, b), by doubling paths: the number of rounds is logarithmic in the longest path."""
    paths = held(pairs.select("a", "b").distinct())
    n = paths.count()
    for _ in range(most):
        longer = paths.alias("p").join(paths.alias("q"), F.col("p.b") == F.col("q.a")).select(F.col("p.a").alias("a"), F.col("q.b").alias("b"))
        paths = held(paths.unionByName(longer).distinct())
        now = paths.count()
        if now == n:
            return paths
        n = now
    raise ValueError("closure didn't settle")


def class_members(types: DataFrame, subclass: DataFrame, name: str) -> DataFrame:
    """(id) of members of class `name`: types (id, class), subclass (a, b) meaning every a is a b."""
    below = closure(subclass).where(F.col("b") == name).select(F.col("a").alias("class"))
    wanted = below.unionByName(types.sparkSession.createDataFrame([(name,)], "class string")).distinct()
    return types.join(wanted, "class").select("id").distinct()


def chain(facts: DataFrame, body: list[str], head: str, confidence: float = 1.0, most: int = 1000) -> DataFrame:
    """Forward chaining of body[0](x, y), body[1](y, z) -> head(x, z) to a fixpoint.

    facts (s, p, o, conf); a derivation's confidence is the rule's times its
    premises', a fact's the largest over derivations. Raises if it hasn't settled
    after `most` rounds, as with a confidence above 1 on a cycle.
    """
    known = held(facts)
    for _ in range(most):
        a, b = known.where(F.col("p") == body[0]), known.where(F.col("p") == body[1])
        new = a.alias("a").join(b.alias("b"), F.col("a.o") == F.col("b.s")).select(F.col("a.s").alias("s"), F.lit(head).alias("p"), F.col("b.o").alias("o"), (confidence * F.col("a.conf") * F.col("b.conf")).alias("conf"))
        best = held(known.unionByName(new).groupBy("s", "p", "o").agg(F.max("conf").alias("conf")))
        if not best.join(known, ["s", "p", "o", "conf"], "left_anti").take(1):
            return best
        known = best
    raise ValueError("chaining didn't settle")


def violations(rows: DataFrame, key: str, least: dict[str, int] | None = None, patterns: dict[str, str] | None = None, allowed: dict[str, list] | None = None, ranges: dict[str, tuple] | None = None) -> DataFrame:
    """(focus, path, constraint) for each failed minCount (null counts 0), pattern, in or range constraint of a row."""
    tests = []
    for c, n in (least or {}).items():
        tests.append((c, "minCount", F.col(c).isNull() & F.lit(n > 0)))
    for c, p in (patterns or {}).items():
        tests.append((c, "pattern", ~F.col(c).rlike(p)))
    for c, v in (allowed or {}).items():
        tests.append((c, "in", ~F.col(c).isin(v)))
    for c, (lo, hi) in (ranges or {}).items():
        tests.append((c, "range", ~F.col(c).between(lo, hi)))
    found = F.array(*[F.when(t, F.struct(F.lit(c).alias("path"), F.lit(k).alias("constraint"))) for c, k, t in tests])
    return rows.select(F.col(key).cast("string").alias("focus"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v")).select("focus", "v.path", "v.constraint")
