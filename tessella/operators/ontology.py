"""OWL RL over triples (s, p, o): rules to a fixpoint, equality, clashes, proofs.

Every round is a union of joins on the predicate's own triples; what is new joins
what is known (semi-naive), so a round's work follows the last round's yield.
Schema triples are few and joined first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, held

TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = "rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range"
SAME, DIFFERENT, INVERSE, DISJOINT, EQUIVALENT = "owl:sameAs", "owl:differentFrom", "owl:inverseOf", "owl:disjointWith", "owl:equivalentClass"
SYMMETRIC, TRANSITIVE, FUNCTIONAL, INVERSE_FUNCTIONAL = "owl:SymmetricProperty", "owl:TransitiveProperty", "owl:FunctionalProperty", "owl:InverseFunctionalProperty"


def _of(t: DataFrame, p: str) -> DataFrame:
    return t.where(F.col("p") == p)


def _typed(t: DataFrame, kind: str) -> DataFrame:
    return t.where((F.col("p") == TYPE) & (F.col("o") == kind)).select(F.col("s").alias("prop"))


def _step(new: DataFrame, known: DataFrame) -> DataFrame:
    """(s, p, o, rule) that follow from a new triple and known ones."""
    out = []

    def add(df: DataFrame, s, p, o, rule: str) -> None:
        out.append(df.select(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(rule).alias("rule")))

    col, lit = F.col, F.lit
    # instances against the schema, both ways round: new instances with known schema, known instances with new schema
    for facts, schema in ((new, known), (known, new)):
        pairs = lambda p: _of(schema, p).select(col("s").alias("a"), col("o").alias("b"))  # noqa: B023, E731
        types = _of(facts, TYPE)
        add(types.join(pairs(SUBCLASS), col("o") == col("a")), col("s"), lit(TYPE), col("b"), "cax-sco")
        same = pairs(EQUIVALENT).unionByName(pairs(EQUIVALENT).select(col("b").alias("a"), col("a").alias("b")))
        add(types.join(same, col("o") == col("a")), col("s"), lit(TYPE), col("b"), "cax-eqc")
        add(facts.join(pairs(SUBPROPERTY), col("p") == col("a")), col("s"), col("b"), col("o"), "prp-spo1")
        add(facts.join(pairs(DOMAIN), col("p") == col("a")), col("s"), lit(TYPE), col("b"), "prp-dom")
        add(facts.join(pairs(RANGE), col("p") == col("a")), col("o"), lit(TYPE), col("b"), "prp-rng")
        inverse = pairs(INVERSE).unionByName(pairs(INVERSE).select(col("b").alias("a"), col("a").alias("b")))
        add(facts.join(inverse, col("p") == col("a")), col("o"), col("b"), col("s"), "prp-inv")
        add(facts.join(_typed(schema, SYMMETRIC), col("p") == col("prop")), col("o"), col("p"), col("s"), "prp-symp")
        add(_of(facts, SUBCLASS).join(pairs(SUBCLASS), col("o") == col("a")), col("s"), lit(SUBCLASS), col("b"), "scm-sco")
        add(_of(facts, SUBPROPERTY).join(pairs(SUBPROPERTY), col("o") == col("a")), col("s"), lit(SUBPROPERTY), col("b"), "scm-spo")
    props = _typed(known, TRANSITIVE)
    whole, fresh = known.join(props, col("p") == col("prop"), "left_semi"), new.join(props, col("p") == col("prop"), "left_semi")
    for left, right in ((fresh, whole), (whole, fresh)):
        a, b = left.select(col("s").alias("x"), col("p").alias("q"), col("o").alias("m")), right.select(col("s").alias("m"), col("p").alias("q"), col("o").alias("y"))
        add(a.join(b, ["q", "m"]), col("x"), col("q"), col("y"), "prp-trp")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def materialise_rl(triples: DataFrame) -> DataFrame:
    """(s, p, o, rule, round): triples and all that follows by the class and property rules; asserted ones have rule null and round 0. Each has the first rule that gave it."""
    asserted = triples.select("s", "p", "o").distinct().withColumn("rule", F.lit(None).cast("string")).withColumn("round", F.lit(0))
    known = new = held(asserted)
    turn = 0
    while True:
        turn += 1
        step = _step(new.select("s", "p", "o"), known.select("s", "p", "o")).groupBy("s", "p", "o").agg(F.min("rule").alias("rule"))
        new = held(step.join(known.select("s", "p", "o"), ["s", "p", "o"], "left_anti").withColumn("round", F.lit(turn)))
        if not new.take(1):
            return known
        known = held(known.unionByName(new))


def same_individuals(triples: DataFrame) -> DataFrame:
    """(id, same): the least name of each group of equal individuals: sameAs, and by functional and inverse functional properties until nothing changes."""
    t = held(triples.select("s", "p", "o").distinct())
    f, i = _typed(t, FUNCTIONAL), _typed(t, INVERSE_FUNCTIONAL)
    by_subject = held(t.join(f, t["p"] == f["prop"], "left_semi"))
    by_object = held(t.join(i, t["p"] == i["prop"], "left_semi"))
    links = held(_of(t, SAME).select(F.col("s").alias("src"), F.col("o").alias("dst")))
    n = -1
    while True:
        found = held(components(links).select("id", F.col("component").alias("same")))
        now = found.count(), found.select("same").distinct().count()
        if now == n:
            return found
        n = now
        name = lambda df, c: df.join(found.select(F.col("id").alias(c), F.col("same").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))  # noqa: B023, E731
        left = name(by_subject, "s").groupBy("_s", "p").agg(F.min("o").alias("dst"), F.collect_set("o").alias("os")).select("dst", F.explode("os").alias("src"))
        right = name(by_object, "o").groupBy("_o", "p").agg(F.min("s").alias("dst"), F.collect_set("s").alias("ss")).select("dst", F.explode("ss").alias("src"))
        links = held(links.unionByName(left.select("src", "dst")).unionByName(right.select("src", "dst")).distinct())


def clashes(triples: DataFrame) -> DataFrame:
    """(id, kind, what): individuals of two disjoint classes, and names that are both equal and different."""
    t = held(triples.select("s", "p", "o").distinct())
    types = _of(t, TYPE).select(F.col("s").alias("id"), F.col("o").alias("c"))
    apart = _of(t, DISJOINT).select(F.col("s").alias("a"), F.col("o").alias("b"))
    both = types.join(apart, types["c"] == apart["a"]).select("id", "a", "b").join(types.select("id", F.col("c").alias("b")), ["id", "b"])
    classes = both.select("id", F.lit("disjoint").alias("kind"), F.concat_ws(" ", F.least("a", "b"), F.greatest("a", "b")).alias("what"))
    same = same_individuals(t)
    other = _of(t, DIFFERENT).join(same.select(F.col("id").alias("s"), F.col("same").alias("x")), "s").join(same.select(F.col("id").alias("o"), F.col("same").alias("y")), "o").where("x = y")
    return classes.unionByName(other.select(F.col("s").alias("id"), F.lit("different").alias("kind"), F.col("o").alias("what"))).distinct()
