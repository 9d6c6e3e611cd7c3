"""SPARQL queries over the data folder as RDF, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import table
from .library import query
from .sparql import RDF, XSD, Dataset

EX = "http://example.org/"
_PREFIX = f"PREFIX ex: <{EX}>\n"


def _iri(kind: str, key: str):
    return F.concat(F.lit(f"<{EX}{kind}/"), F.col(key).cast("string"), F.lit(">"))


def _typed(c: str, kind: str):
    return F.concat(F.lit('"'), F.col(c).cast("string"), F.lit(f'"^^<{XSD}{kind}>'))


def _text(c: str, tag: str = ""):
    return F.concat(F.lit('"'), F.col(c), F.lit(f'"{tag}'))


def triples(spark, sf_dir) -> DataFrame:
    """Regions, nations, customers and suppliers: types, names, places, balances."""
    out = None

    def add(df, s, p, o):
        nonlocal out
        some = df.select(s.alias("s"), F.lit(p if p.startswith("<") else f"<{EX}{p}>").alias("p"), o.alias("o"))
        out = some if out is None else out.unionByName(some)

    for name, key, letter in (("region", "r_regionkey", "r"), ("nation", "n_nationkey", "n"), ("customer", "c_custkey", "c"), ("supplier", "s_suppkey", "s")):
        df, me = table(spark, sf_dir, name), _iri(name, key)
        add(df, me, f"<{RDF}type>", F.lit(f"<{EX}{name.capitalize()}>"))
        add(df, me, "name", _text(f"{letter}_name", "@en" if name in ("region", "nation") else ""))
        if name == "nation":
            add(df, me, "within", _iri("region", "n_regionkey"))
        if name in ("customer", "supplier"):
            add(df, me, "within", _iri("nation", f"{letter}_nationkey"))
            add(df, me, "balance", _typed(f"{letter}_acctbal", "double"))
        if name == "customer":
            add(df, me, "segment", _text("c_mktsegment"))
    return out


def dataset(spark, sf_dir) -> Dataset:
    """The triples in the default graph, and nations' places once more in the graph ex:geo."""
    t = triples(spark, sf_dir)
    q = t.select(F.lit(None).cast("string").alias("g"), "s", "p", "o")
    geo = t.where(F.col("s").startswith(f"<{EX}nation/") & (F.col("p") == f"<{EX}within>")).select(F.lit(f"<{EX}geo>").alias("g"), "s", "p", "o")
    return Dataset(q.unionByName(geo))


def sparql(name: str, text: str, oracle: str | None) -> None:
    def run(spark, sf_dir):
        d = dataset(spark, sf_dir)
        d.services["http://example.org/geo-service"] = Dataset.of_triples(d.quads.where("g IS NOT NULL"))
        return d.query(_PREFIX + text)

    run.__name__ = name
    query(oracle)(run)


_C, _N, _R, _S = (f"'{EX}{k}/' || " for k in ("customer", "nation", "region", "supplier"))

sparql(
    "sparql_filter_order",
    "SELECT ?c ?b WHERE { ?c a ex:Customer ; ex:balance ?b . FILTER(?b > 9500 && !(?b >= 9900)) } ORDER BY DESC(?b) ?c LIMIT 10 OFFSET 1",
    f"SELECT {_C}c_custkey AS c, CAST(c_acctbal AS VARCHAR) AS b FROM customer WHERE c_acctbal > 9500 AND NOT c_acctbal >= 9900 ORDER BY c_acctbal DESC, {_C}c_custkey LIMIT 10 OFFSET 1",
)
sparql(
    "sparql_path_sequence",
    f"SELECT ?c ?r WHERE {{ ?c a ex:Customer . ?c ex:within/ex:within ?r . ?r ^ex:within <{EX}nation/3> }}",
    f"SELECT {_C}c_custkey AS c, {_R}n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)",
)
sparql(
    "sparql_path_closure",
    "SELECT ?x ?up WHERE { ?x a ex:Nation . ?x ex:within+ ?up }",
    f"SELECT {_N}n_nationkey AS x, {_R}n_regionkey AS up FROM nation",
)
sparql(
    "sparql_path_star_inverse",
    f"SELECT (COUNT(*) AS ?n) WHERE {{ <{EX}region/1> (^ex:within)* ?x }}",
    "SELECT CAST(1 + count(DISTINCT n_nationkey) + (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1) + (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1) AS DOUBLE) AS n FROM nation WHERE n_regionkey = 1",
)
sparql(
    "sparql_path_alternative",
    "SELECT ?p ?v WHERE { ?p a ex:Supplier . ?p ex:name|ex:balance ?v }",
    f"SELECT {_S}s_suppkey AS p, s_name AS v FROM supplier UNION ALL SELECT {_S}s_suppkey, CAST(s_acctbal AS VARCHAR) FROM supplier",
)
sparql(
    "sparql_path_negated",
    "SELECT ?n ?v WHERE { ?n a ex:Nation . ?n !(rdf:type|ex:within) ?v }",
    f"SELECT {_N}n_nationkey AS n, n_name AS v FROM nation",
)
sparql(
    "sparql_path_optional_step",
    f"SELECT ?x WHERE {{ <{EX}nation/2> ex:within? ?x }}",
    f"SELECT {_N}2 AS x UNION ALL SELECT {_R}n_regionkey FROM nation WHERE n_nationkey = 2",
)
sparql(
    "sparql_optional",
    "SELECT ?n ?c WHERE { ?n a ex:Nation OPTIONAL { ?c ex:within ?n ; a ex:Customer ; ex:balance ?b . FILTER(?b > 9900) } }",
    f"SELECT {_N}n_nationkey AS n, {_C}c_custkey AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900",
)
sparql(
    "sparql_union_minus",
    "SELECT ?x WHERE { { ?x a ex:Customer } UNION { ?x a ex:Supplier } MINUS { ?x ex:balance ?b FILTER(?b < 8000) } }",
    f"SELECT {_C}c_custkey AS x FROM customer WHERE NOT c_acctbal < 8000 UNION ALL SELECT {_S}s_suppkey FROM supplier WHERE NOT s_acctbal < 8000",
)
sparql(
    "sparql_values_subselect",
    f"SELECT ?n ?customers WHERE {{ VALUES ?n {{ <{EX}nation/1> <{EX}nation/7> }} {{ SELECT ?n (COUNT(?c) AS ?customers) WHERE {{ ?c ex:within ?n ; a ex:Customer }} GROUP BY ?n }} }}",
    f"SELECT {_N}c_nationkey AS n, CAST(count(*) AS DOUBLE) AS customers FROM customer WHERE c_nationkey IN (1, 7) GROUP BY 1",
)
sparql(
    "sparql_service",
    f"SELECT ?n ?r WHERE {{ ?n ex:name ?name . FILTER(STRSTARTS(?name, 'NATION')) SERVICE <{EX}geo-service> {{ ?n ex:within ?r }} }}",
    f"SELECT {_N}n_nationkey AS n, {_R}n_regionkey AS r FROM nation WHERE starts_with(n_name, 'NATION')",
)
sparql("sparql_graph", "SELECT ?g ?n ?r WHERE { GRAPH ?g { ?n ex:within ?r } ?n a ex:Nation }", f"SELECT '{EX}geo' AS g, {_N}n_nationkey AS n, {_R}n_regionkey AS r FROM nation")
sparql("sparql_from", "SELECT ?s ?o FROM ex:geo WHERE { ?s ?p ?o }", f"SELECT {_N}n_nationkey AS s, {_R}n_regionkey AS o FROM nation")
sparql("sparql_distinct", "SELECT DISTINCT ?segment WHERE { ?c ex:segment ?segment } ORDER BY ?segment", "SELECT DISTINCT c_mktsegment AS segment FROM customer")
sparql(
    "sparql_aggregates",
    "SELECT ?seg (COUNT(*) AS ?n) (ROUND(SUM(?b)) AS ?total) (FLOOR(AVG(?b)) AS ?mean) (MIN(?b) AS ?low) (MAX(?b) AS ?high) (COUNT(DISTINCT ?nat) AS ?nations) (GROUP_CONCAT(DISTINCT ?nat; SEPARATOR=',') AS ?names) WHERE { ?c ex:segment ?seg ; ex:balance ?b ; ex:within ?nat } GROUP BY ?seg HAVING (COUNT(*) > 5)",
    f"SELECT c_mktsegment AS seg, CAST(count(*) AS DOUBLE) AS n, floor(sum(c_acctbal) + 0.5) AS total, floor(avg(c_acctbal)) AS mean, CAST(min(c_acctbal) AS VARCHAR) AS low, CAST(max(c_acctbal) AS VARCHAR) AS high, CAST(count(DISTINCT c_nationkey) AS DOUBLE) AS nations, string_agg(DISTINCT {_N}c_nationkey, ',' ORDER BY {_N}c_nationkey) AS names FROM customer GROUP BY 1 HAVING count(*) > 5",
)
sparql(
    "sparql_bind_if_coalesce",
    "SELECT ?c ?half ?kind ?say WHERE { ?c a ex:Customer ; ex:balance ?b . OPTIONAL { ?c ex:none ?z } BIND(?b / 2 AS ?half) BIND(IF(?b < 0, 'debt', 'credit') AS ?kind) BIND(COALESCE(?z, 'nothing') AS ?say) }",
    f"SELECT {_C}c_custkey AS c, c_acctbal / 2 AS half, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS kind, 'nothing' AS say FROM customer",
)
sparql(
    "sparql_exists",
    "SELECT ?n WHERE { ?n a ex:Nation FILTER EXISTS { ?c ex:within ?n ; ex:balance ?b FILTER(?b > 9000) } FILTER NOT EXISTS { ?s a ex:Supplier ; ex:within ?n ; ex:balance ?d FILTER(?d < -900) } }",
    f"SELECT {_N}n_nationkey AS n FROM nation WHERE (EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < -900)",
)
sparql(
    "sparql_term_tests",
    "SELECT ?o (isIRI(?o) AS ?iri) (isLiteral(?o) AS ?lit) (isBlank(?o) AS ?blank) (isNumeric(?o) AS ?num) WHERE { ?s a ex:Supplier ; ?p ?o . FILTER(?p IN (ex:within, ex:balance, ex:name)) }",
    f"SELECT * FROM (SELECT {_N}s_nationkey AS o, true AS iri, false AS lit, false AS blank, false AS num FROM supplier UNION ALL SELECT CAST(s_acctbal AS VARCHAR), false, true, false, true FROM supplier UNION ALL SELECT s_name, false, true, false, false FROM supplier)",
)
sparql(
    "sparql_string_functions",
    "SELECT ?c (STRLEN(?n) AS ?len) (SUBSTR(?n, 1, 4) AS ?sub) (UCASE(?n) AS ?up) (LCASE(?seg) AS ?low) (CONCAT(?seg, '-', ?n) AS ?both) (STRBEFORE(?n, '#') AS ?before) (STRAFTER(?n, '#') AS ?after) (REPLACE(?n, '0+', 'z') AS ?rep) WHERE { ?c ex:segment ?seg ; ex:name ?n FILTER(CONTAINS(?seg, 'U') && REGEX(?n, '^c', 'i') && STRENDS(?n, '1')) }",
    f"SELECT {_C}c_custkey AS c, CAST(length(c_name) AS DOUBLE) AS len, substr(c_name, 1, 4) AS sub, upper(c_name) AS up, lower(c_mktsegment) AS low, c_mktsegment || '-' || c_name AS both, CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 1) ELSE '' END AS before, CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 2) ELSE '' END AS after, regexp_replace(c_name, '0+', 'z', 'g') AS rep FROM customer WHERE contains(c_mktsegment, 'U') AND regexp_matches(lower(c_name), '^c') AND ends_with(c_name, '1')",
)
sparql("sparql_encode_uri", "SELECT ?r (ENCODE_FOR_URI(CONCAT(?n, ' & 1/2')) AS ?u) WHERE { ?r a ex:Region ; ex:name ?n }", f"SELECT {_R}r_regionkey AS r, url_encode(r_name || ' & 1/2') AS u FROM region")
sparql(
    "sparql_digests",
    "SELECT ?r (MD5(STR(?n)) AS ?a) (SHA1(STR(?n)) AS ?b) (SHA256(STR(?n)) AS ?c) WHERE { ?r a ex:Region ; ex:name ?n }",
    f"SELECT {_R}r_regionkey AS r, md5(r_name) AS a, sha1(r_name) AS b, sha256(r_name) AS c FROM region",
)
sparql(
    "sparql_dates",
    f"SELECT (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?day) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?min) (SECONDS(?d) AS ?sec) (TZ(?d) AS ?tz) (TIMEZONE(?d) AS ?zone) (NOW() > ?d AS ?past) WHERE {{ VALUES ?d {{ '2024-03-09T17:05:42Z'^^<{XSD}dateTime> '1999-12-31T23:59:01-05:30'^^<{XSD}dateTime> }} }}",
    "SELECT * FROM (VALUES (2024.0::DOUBLE, 3.0::DOUBLE, 9.0::DOUBLE, 17.0::DOUBLE, 5.0::DOUBLE, 42.0::DOUBLE, 'Z', 'PT0S', true), (1999, 12, 31, 23, 59, 1, '-05:30', '-PT5H30M', true)) t(y, m, day, h, min, sec, tz, zone, past)",
)
sparql(
    "sparql_numeric_functions",
    "SELECT ?c (ABS(?b) AS ?a) (ROUND(?b) AS ?r) (CEIL(?b) AS ?u) (FLOOR(?b) AS ?f) (xsd:integer(?b) AS ?i) (RAND() < 1 AS ?ok) (STRLEN(STRUUID()) AS ?len) (isIRI(IRI(CONCAT('urn:', ?seg))) AS ?iri) WHERE { ?c ex:balance ?b ; ex:segment ?seg }",
    f"SELECT {_C}c_custkey AS c, abs(c_acctbal) AS a, floor(c_acctbal + 0.5) AS r, ceil(c_acctbal) AS u, floor(c_acctbal) AS f, CAST(trunc(c_acctbal) AS BIGINT) AS i, true AS ok, 36.0::DOUBLE AS len, true AS iri FROM customer",
)
sparql(
    "sparql_language_datatype",
    "SELECT ?n (LANG(?name) AS ?lang) (LANGMATCHES(LANG(?name), 'EN') AS ?match) (DATATYPE(?name) AS ?type) (BOUND(?z) AS ?bound) WHERE { ?n a ex:Nation ; ex:name ?name OPTIONAL { ?n ex:none ?z } }",
    f"SELECT {_N}n_nationkey AS n, 'en' AS lang, true AS match, '{RDF}langString' AS type, false AS bound FROM nation",
)
sparql("sparql_ask", f"ASK {{ ?c ex:within <{EX}nation/1> ; ex:balance ?b FILTER(?b > 100000) }}", "SELECT count(*) > 0 AS answer FROM customer WHERE c_nationkey = 1 AND c_acctbal > 100000")
sparql(
    "sparql_construct",
    "CONSTRUCT { ?r ex:holds ?c . ?c ex:rich true } WHERE { ?c ex:within/ex:within ?r ; ex:balance ?b FILTER(?b > 9900) }",
    f"SELECT '<{EX}region/' || n_regionkey || '>' AS s, '<{EX}holds>' AS p, '<{EX}' || k || '>' AS o FROM (SELECT 'customer/' || c_custkey AS k, c_nationkey AS nk FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT 'supplier/' || s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 9900) JOIN nation ON nk = n_nationkey UNION ALL SELECT '<{EX}' || k || '>', '<{EX}rich>', '\"true\"^^<{XSD}boolean>' FROM (SELECT 'customer/' || c_custkey AS k FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier WHERE s_acctbal > 9900)",
)
sparql("sparql_describe", f"DESCRIBE <{EX}region/1>", f"SELECT '<{EX}region/1>' AS s, '<{RDF}type>' AS p, '<{EX}Region>' AS o UNION ALL SELECT '<{EX}region/1>', '<{EX}name>', '\"' || r_name || '\"@en' FROM region WHERE r_regionkey = 1")


@query(f"SELECT {_C}c_custkey AS c, 0.75::DOUBLE AS p FROM customer WHERE c_acctbal > 9900")
def sparql_quoted_triples(spark, sf_dir):
    d = dataset(spark, sf_dir)
    d = d.update(_PREFIX + "INSERT { << ?c ex:within ?n >> ex:certainty 0.75 } WHERE { ?c a ex:Customer ; ex:within ?n ; ex:balance ?b FILTER(?b > 9900) }")
    return d.query(_PREFIX + "SELECT ?c (?q * 1 AS ?p) WHERE { << ?c ex:within ?n >> ex:certainty ?q . ?n a ex:Nation }")


@query(
    f"""SELECT '<{EX}nation/' || n_nationkey || '>' AS s, '<{EX}part>' AS p, '<{EX}region/' || n_regionkey || '>' AS o FROM nation WHERE n_regionkey <> 2
    UNION ALL SELECT '<{EX}nation/x>', '<{EX}part>', '<{EX}region/0>'"""
)
def sparql_update(spark, sf_dir):
    d = dataset(spark, sf_dir).update(
        _PREFIX + "DELETE { ?n ex:within ?r } INSERT { GRAPH ex:new { ?n ex:part ?r } } WHERE { ?n a ex:Nation ; ex:within ?r } ;"
        f"INSERT DATA {{ GRAPH ex:new {{ <{EX}nation/x> ex:part <{EX}region/0> , <{EX}region/9> }} }} ; DELETE DATA {{ GRAPH ex:new {{ <{EX}nation/x> ex:part <{EX}region/9> }} }} ;"
        f"DELETE WHERE {{ GRAPH ex:new {{ ?n ex:part <{EX}region/2> }} }} ; CLEAR DEFAULT ; COPY GRAPH ex:new TO DEFAULT ; DROP GRAPH ex:geo ; MOVE ex:new TO ex:other"
    )
    return d.quads.where("g IS NULL").select("s", "p", "o")
