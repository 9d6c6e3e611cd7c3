"""A SQL session over a data folder: tables, the library's functions, views, statements that change tables.

Functions are SQL expressions registered once in the session, so Catalyst inlines
them: nothing here runs row by row in Python. Tables that are written to are
versioned Parquet folders (sources.lake); a statement reads one version and
writes the next. Views that are materialised keep their text and are refreshed on
demand.

    e = Engine(spark, folder)
    e.sql("CREATE TEMPORARY FUNCTION net(p DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN p * (1 - d)")
    e.sql("SELECT l_returnflag, sum(net(l_extendedprice, l_discount)) FROM lineitem GROUP BY 1")
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import TABLES, edges, nodes, table
from ..operators import graph

#: name(parameters): result, body. Ranges are half open; a null bound is infinite.
FUNCTIONS = (
    "int4range(lo INT, hi INT) RETURNS STRUCT<lo: INT, hi: INT> RETURN named_struct('lo', lo, 'hi', hi)",
    "numrange(lo DOUBLE, hi DOUBLE) RETURNS STRUCT<lo: DOUBLE, hi: DOUBLE> RETURN named_struct('lo', lo, 'hi', hi)",
    "tsrange(lo TIMESTAMP, hi TIMESTAMP) RETURNS STRUCT<lo: TIMESTAMP, hi: TIMESTAMP> RETURN named_struct('lo', lo, 'hi', hi)",
    "range_contains(r STRUCT<lo: DOUBLE, hi: DOUBLE>, x DOUBLE) RETURNS BOOLEAN RETURN (r.lo IS NULL OR x >= r.lo) AND (r.hi IS NULL OR x < r.hi)",
    "range_overlaps(a STRUCT<lo: DOUBLE, hi: DOUBLE>, b STRUCT<lo: DOUBLE, hi: DOUBLE>) RETURNS BOOLEAN RETURN (a.lo IS NULL OR b.hi IS NULL OR a.lo < b.hi) AND (b.lo IS NULL OR a.hi IS NULL OR b.lo < a.hi)",
    "range_contains_range(a STRUCT<lo: DOUBLE, hi: DOUBLE>, b STRUCT<lo: DOUBLE, hi: DOUBLE>) RETURNS BOOLEAN RETURN (a.lo IS NULL OR coalesce(b.lo >= a.lo, FALSE)) AND (a.hi IS NULL OR coalesce(b.hi <= a.hi, FALSE))",
    "range_intersection(a STRUCT<lo: DOUBLE, hi: DOUBLE>, b STRUCT<lo: DOUBLE, hi: DOUBLE>) RETURNS STRUCT<lo: DOUBLE, hi: DOUBLE> RETURN named_struct('lo', greatest(a.lo, b.lo), 'hi', least(a.hi, b.hi))",
    "range_adjacent(a STRUCT<lo: DOUBLE, hi: DOUBLE>, b STRUCT<lo: DOUBLE, hi: DOUBLE>) RETURNS BOOLEAN RETURN a.hi = b.lo OR b.hi = a.lo",
    "epistemic_decay(confidence DOUBLE, age_days DOUBLE, half_life DOUBLE) RETURNS DOUBLE RETURN confidence * CASE WHEN age_days <= 0 THEN 1 ELSE exp(-ln(2.0D) * age_days / half_life) END",
    "bucket_seconds(width BIGINT, at TIMESTAMP) RETURNS TIMESTAMP RETURN timestamp_micros(unix_micros(at) - pmod(unix_micros(at), width * 1000000))",
    "json_text(doc STRING, key STRING) RETURNS STRING RETURN get_json_object(doc, concat('$.', key))",
    "json_f64(doc STRING, key STRING) RETURNS DOUBLE RETURN try_cast(get_json_object(doc, concat('$.', key)) AS DOUBLE)",
    "json_i64(doc STRING, key STRING) RETURNS BIGINT RETURN try_cast(get_json_object(doc, concat('$.', key)) AS BIGINT)",
    "json_bool(doc STRING, key STRING) RETURNS BOOLEAN RETURN try_cast(get_json_object(doc, concat('$.', key)) AS BOOLEAN)",
    "array_has_all(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS BOOLEAN RETURN size(array_except(b, a)) = 0",
    "array_has_any(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS BOOLEAN RETURN arrays_overlap(a, b)",
    "array_length(a ARRAY<BIGINT>, dim INT) RETURNS INT RETURN CASE WHEN dim = 1 AND size(a) > 0 THEN size(a) END",
    "vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vec_l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "vec_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
    "cosine_sim(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))",
    "l2_normalize(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN CASE WHEN aggregate(a, 0D, (s, x) -> s + x * x) > 0 THEN transform(a, v -> v / sqrt(aggregate(a, 0D, (s, x) -> s + x * x))) ELSE a END",
    "st_point_distance(ax DOUBLE, ay DOUBLE, bx DOUBLE, by_ DOUBLE) RETURNS DOUBLE RETURN sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_))",
    "clamp_between(x DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE RETURN greatest(lo, least(hi, x))",
    "minhash_signature(words ARRAY<STRING>, k INT) RETURNS ARRAY<BIGINT> RETURN CASE WHEN size(words) > 0 THEN transform(sequence(1, k), i -> array_min(transform(words, w -> xxhash64(w, i)))) ELSE array() END",
    "minhash_similarity(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS DOUBLE RETURN try_divide(aggregate(zip_with(a, b, (x, y) -> CASE WHEN x = y THEN 1D ELSE 0D END), 0D, (s, x) -> s + x), CAST(size(a) AS DOUBLE))",
)


class Engine:
    def __init__(self, spark: SparkSession, sf_dir: str, folder: str | None = None):
        """folder: where tables that statements create are kept; needed only for these."""
        self.parent, self.sf_dir, self.folder = spark, sf_dir, folder
        self.session = spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
            self.session.conf.set(key, spark.conf.get(key))
        self.known: set[str] = set()
        self.made: dict[str, DataFrame] = {}
        self.views: dict[str, str] = {}
        self.undo: list[dict] | None = None
        self.graphs: dict[str, tuple[Callable[[], DataFrame], Callable[[], DataFrame]]] = {}
        for f in FUNCTIONS:
            self.session.sql(f"CREATE TEMPORARY FUNCTION {f}")

    # --- statements
    def sql(self, text: str, **params) -> DataFrame:
        text = text.strip().rstrip(";")
        for pattern, act in self._statements():
            m = re.fullmatch(pattern, text, re.I | re.S)
            if m:
                return act(*m.groups()) or self._status()
        text = self._expanded(text)
        self._show(text)
        return self.session.sql(text, params or None)

    def _statements(self):
        name = r"(\w+)"
        return (
            (rf"CREATE\s+TABLE\s+{name}\s+AS\s+(.*)", self.create_as),
            (rf"CREATE\s+TABLE\s+{name}\s*\((.*)\)", self.create),
            (rf"DROP\s+TABLE\s+{name}", self.drop),
            (rf"ALTER\s+TABLE\s+{name}\s+ADD\s+COLUMN\s+{name}\s+(\w+)", self.add_column),
            (rf"INSERT\s+INTO\s+{name}\s+(.*?)(?:\s+ON\s+CONFLICT\s*\((.*?)\)\s*DO\s+(NOTHING|UPDATE))?", self.insert),
            (rf"UPDATE\s+{name}\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?", self.update),
            (rf"DELETE\s+FROM\s+{name}(?:\s+WHERE\s+(.*))?", self.delete),
            (rf"CREATE\s+MATERIALIZED\s+VIEW\s+{name}\s+AS\s+(.*)", self.create_materialised),
            (rf"REFRESH\s+MATERIALIZED\s+VIEW\s+{name}", self.refresh),
            (rf"COPY\s+{name}\s+TO\s+'([^']+)'(?:\s+WITH)?\s*(\(.*\))?", self.copy_to),
            (rf"COPY\s+{name}\s+FROM\s+'([^']+)'(?:\s+WITH)?\s*(\(.*\))?", self.copy_from),
            (r"(BEGIN)", lambda _: self.begin()),
            (r"(COMMIT)", lambda _: self.commit()),
            (r"(ROLLBACK)", lambda _: self.rollback()),
            (rf"CREATE\s+PROPERTY\s+GRAPH\s+{name}\s+VERTEX\s+TABLES\s*\((.*?)\)\s*EDGE\s+TABLES\s*\((.*)\)", self.create_graph),
        )

    def _status(self) -> DataFrame:
        return self.session.createDataFrame([("ok",)], "status string")

    def _show(self, text: str) -> None:
        """Views of the folder's tables that the text names, once each."""
        for name in TABLES:
            if name not in self.known and name not in self.made and re.search(rf"\b{name}\b", text):
                table(self.session, self.sf_dir, name).createOrReplaceTempView(name)
                self.known.add(name)

    def _expanded(self, text: str) -> str:
        """Table functions of the graph, GRAPH_TABLE and the catalog replaced by views."""
        for fn, make in (("pagerank", graph.pagerank), ("components", graph.components), ("degrees", graph.degrees)):
            for m in list(re.finditer(rf"\b{fn}\(\s*((?:'\w+'\s*,?\s*)*)\)", text)):
                rels = re.findall(r"'(\w+)'", m[1])
                text = text.replace(m[0], self._view(make(edges(self.session, self.sf_dir, *rels))))
        for m in list(re.finditer(r"GRAPH_TABLE\s*\(\s*(\w+)\s+(MATCH\s+.*?)\s+COLUMNS\s*\((.*?)\)\s*\)", text, re.I | re.S)):
            from .cypher import Graph

            ns, es = self.graphs[m[1]]
            found = Graph(ns(), es()).query(f"{m[2]} RETURN {m[3]}")
            text = text.replace(m[0], self._view(found))
        for m in set(re.findall(r"\b(information_schema\.(?:tables|columns)|pg_catalog\.pg_(?:class|proc))\b", text, re.I)):
            text = re.sub(re.escape(m), self._view(self.catalog(m.lower())), text)
        return text

    def _view(self, df: DataFrame) -> str:
        name = f"_v{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        return f"`{name}`"

    def catalog(self, which: str) -> DataFrame:
        if which.endswith("pg_proc"):
            return self.session.createDataFrame([(f[: f.index("(")],) for f in FUNCTIONS], "proname string")
        frames = {n: table(self.session, self.sf_dir, n) for n in TABLES if n not in self.made} | self.made
        if which.endswith("columns"):
            rows = [(n, c, i + 1, t) for n, df in sorted(frames.items()) for i, (c, t) in enumerate(df.dtypes)]
            return self.session.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string")
        rows = [(n, "VIEW" if n in self.views else "BASE TABLE") for n in sorted(frames)]
        return self.session.createDataFrame(rows, "table_name string, table_type string" if which.endswith("tables") else "relname string, relkind string")

    # --- tables
    def _held(self, df: DataFrame) -> DataFrame:
        if not self.folder:
            raise ValueError("an engine that writes needs a folder")
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.session.read.schema(df.schema).parquet(path)

    def _set(self, name: str, df: DataFrame | None) -> None:
        if df is None:
            self.made.pop(name, None)
            self.session.catalog.dropTempView(name)
        else:
            self.made[name] = df
            df.createOrReplaceTempView(name)

    def _get(self, name: str) -> DataFrame:
        if name not in self.made:
            raise ValueError(f"no table {name} that can be changed")
        return self.made[name]

    def create_as(self, name: str, text: str) -> None:
        self._set(name, self._held(self.sql(text)))

    def create(self, name: str, columns: str) -> None:
        self._set(name, self._held(self.session.createDataFrame([], columns)))

    def drop(self, name: str) -> None:
        self._get(name)
        self._set(name, None)

    def add_column(self, name: str, column: str, kind: str) -> None:
        self._set(name, self._held(self._get(name).withColumn(column, F.lit(None).cast(kind))))

    def insert(self, name: str, text: str, keys: str | None = None, act: str | None = None) -> None:
        """Rows of a query or VALUES; on conflict of keys the old row stays or the new one takes its place."""
        old = self._get(name)
        columns = re.match(r"\(([\w\s,]+)\)\s*(.*)", text, re.S)
        names = [c.strip() for c in columns[1].split(",")] if columns else old.columns
        new = self.sql(columns[2] if columns else text).toDF(*names)
        new = new.select(*[(F.col(c) if c in names else F.lit(None)).cast(t).alias(c) for c, t in old.dtypes])
        if keys:
            on = [k.strip() for k in keys.split(",")]
            new = new.dropDuplicates(on)
            if act.upper() == "NOTHING":
                new = new.join(old.select(*on), on, "left_anti").select(*old.columns)
            else:
                old = old.join(new.select(*on), on, "left_anti").select(*old.columns)
        self._set(name, self._held(old.unionByName(new)))

    def update(self, name: str, changes: str, where: str | None = None) -> None:
        df, test = self._get(name), F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        parts = re.split(r",\s*(?=\w+\s*=)", changes)
        new = {c.strip(): F.expr(e) for c, _, e in (p.partition("=") for p in parts)}
        kinds = dict(df.dtypes)
        self._set(name, self._held(df.select(*[F.when(test, new[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])))

    def delete(self, name: str, where: str | None = None) -> None:
        df = self._get(name)
        self._set(name, self._held(df.where(~F.coalesce(F.expr(where), F.lit(False))) if where else df.limit(0)))

    def create_materialised(self, name: str, text: str) -> None:
        self.views[name] = text
        self._set(name, self._held(self.sql(text)))

    def refresh(self, name: str) -> None:
        self._set(name, self._held(self.sql(self.views[name])))

    @staticmethod
    def _options(text: str | None) -> dict[str, str]:
        found = dict(re.findall(r"(\w+)\s+'?([^',)]+)'?", text or ""))
        return {k.lower(): v for k, v in found.items()}

    def copy_to(self, name: str, path: str, options: str | None = None) -> None:
        o = self._options(options)
        df = self.sql(f"SELECT * FROM {name}")
        form = o.get("format", "csv").lower()
        writer = df.write.mode("overwrite").format(form)
        if form == "csv":
            writer = writer.option("header", o.get("header", "false")).option("sep", o.get("delimiter", ","))
        writer.save(path)

    def copy_from(self, name: str, path: str, options: str | None = None) -> None:
        o = self._options(options)
        old, form = self._get(name), o.get("format", "csv").lower()
        reader = self.session.read.format(form).schema(old.schema)
        if form == "csv":
            reader = reader.option("header", o.get("header", "false")).option("sep", o.get("delimiter", ","))
        self._set(name, self._held(old.unionByName(reader.load(path))))

    # --- transactions: versions are immutable, so going back is naming the old ones
    def begin(self) -> None:
        self.undo = [*(self.undo or []), dict(self.made)]

    def commit(self) -> None:
        self.undo = (self.undo or [])[:-1] or None

    def rollback(self) -> None:
        if not self.undo:
            raise ValueError("no transaction")
        before = self.undo.pop()
        for name in set(self.made) | set(before):
            self._set(name, before.get(name))

    # --- property graphs
    def create_graph(self, name: str, vertices: str, links: str) -> None:
        """Vertices `t KEY (k) LABEL l`, edges `t SOURCE KEY (a) REFERENCES l DESTINATION KEY (b) REFERENCES m LABEL r`; ids are label:key."""
        vs = re.findall(r"(\w+)\s+KEY\s*\((\w+)\)\s*LABEL\s+(\w+)", vertices, re.I)
        es = re.findall(r"(\w+)\s+SOURCE\s+KEY\s*\((\w+)\)\s*REFERENCES\s+(\w+)\s+DESTINATION\s+KEY\s*\((\w+)\)\s*REFERENCES\s+(\w+)\s+LABEL\s+(\w+)", links, re.I)
        of = lambda label, key: F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))

        def all_of(frames):
            out = None
            for f in frames:
                out = f if out is None else out.unionByName(f, allowMissingColumns=True)
            return out

        def ns() -> DataFrame:
            return all_of(self.sql(f"SELECT * FROM {t}").select(of(label, k).alias("id"), F.lit(label).alias("label"), "*") for t, k, label in vs)

        def links_of() -> DataFrame:
            return all_of(self.sql(f"SELECT * FROM {t}").select(of(la, a).alias("src"), of(lb, b).alias("dst"), F.lit(rel).alias("rel")) for t, a, la, b, lb, rel in es)

        self.graphs[name] = (ns, links_of)


def graph_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return nodes(spark, sf_dir), edges(spark, sf_dir)
