"""PromQL over samples (name, labels.., t in seconds, value), evaluated at one instant.

    topk(3, sum by (job) (rate(requests{code=~"5..", job!="test"}[5m] offset 1m))) > 0.5

Instant selectors take a series' last sample within LOOKBACK; range selectors feed
the _over_time family, rate, increase, irate, delta, idelta and deriv. Vectors are
frames with a column for each label and value; each operator is one filter,
aggregation or equi-join, so all series are worked on together. Binary operators
match on all labels or those of on(..) or ignoring(..); comparisons filter, or
give 0 and 1 with bool. Label columns are those of the samples besides name, t
and value; a missing label is null and equals "".
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOOKBACK = 300


class PromqlFault(ValueError):
    """The expression can't be read."""


_TOKEN = re.compile(r"\s*(?:(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(\d+(?:\.\d+)?(?:ms|[smhdwy])(?![\w.]))|(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|([A-Za-z_:][\w:]*)|(==|!=|>=|<=|=~|!~|[-+*/%^(){}\[\],=<>]))")
_UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 31536000}
_FOLDS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "stddev": F.stddev_pop, "stdvar": F.var_pop}
_MAPS = {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "exp": F.exp, "ln": F.log, "log2": F.log2, "log10": F.log10, "sqrt": F.sqrt, "sgn": F.signum}
_RANKS = (("or",), ("and", "unless"), ("==", "!=", ">=", "<=", ">", "<"), ("+", "-"), ("*", "/", "%"), ("^",))


class _Eval:
    def __init__(self, text: str, samples: DataFrame, at: float):
        self.tokens, here, text = [], 0, text.strip()
        while here < len(text):
            m = _TOKEN.match(text, here)
            if not m:
                raise PromqlFault(f"unexpected {text[here : here + 20]!r}")
            self.tokens.append(m[0].strip())
            here = m.end()
        self.i, self.samples, self.at = 0, samples, at
        self.labels = [c for c in samples.columns if c not in ("name", "t", "value")]

    def peek(self) -> str:
        return self.tokens[self.i] if self.i < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        t = self.peek()
        if not t or wanted and t != wanted:
            raise PromqlFault(f"expected {wanted or 'more'}, found {t or 'the end'!r}")
        self.i += 1
        return t

    def names(self) -> list[str]:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.take())
            if self.peek() == ",":
                self.take()
        self.take(")")
        return out

    @staticmethod
    def span(t: str) -> float:
        m = re.fullmatch(r"(\d+(?:\.\d+)?)(ms|[smhdwy])", t)
        if not m:
            raise PromqlFault(f"not a duration: {t!r}")
        return float(m[1]) * _UNITS[m[2]]

    # --- expressions: a float or a frame (labels.., value)
    def expression(self, rank: int = 0):
        if rank == len(_RANKS):
            return self.unary()
        left = self.expression(rank + 1)
        while self.peek() in _RANKS[rank]:
            op = self.take()
            flag = self.peek() == "bool"
            if flag:
                self.take()
            on = None
            if self.peek() in ("on", "ignoring"):
                which = self.take()
                some = self.names()
                on = some if which == "on" else [c for c in self.labels if c not in some]
            left = self.binary(op, left, self.expression(rank + 1), flag, on)
        return left

    def unary(self):
        if self.peek() == "-":
            self.take()
            return self.binary("*", -1.0, self.unary(), False, None)
        return self.atom()

    def binary(self, op: str, a, b, flag: bool, on: list[str] | None):
        tests = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, ">": lambda x, y: x > y, "<": lambda x, y: x < y, ">=": lambda x, y: x >= y, "<=": lambda x, y: x <= y}
        sums = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: F.try_divide(x, y), "%": lambda x, y: F.try_mod(x, y), "^": lambda x, y: F.pow(x, y)}
        frames = [isinstance(x, DataFrame) for x in (a, b)]
        if op in ("and", "or", "unless"):
            keys = [c for c in (on or self.labels) if c in a.columns and c in b.columns]
            same = F.lit(True)
            theirs = b.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            if op != "or":
                return a.join(theirs, same, "left_semi" if op == "and" else "left_anti")
            mine = a.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
            return a.unionByName(b.join(mine, same, "left_anti"), allowMissingColumns=True)
        if not any(frames):
            v = {"+": a + b, "-": a - b, "*": a * b}.get(op) if op in "+-*" else a / b if op == "/" else a % b if op == "%" else a**b if op == "^" else None
            return float(tests[op](a, b)) if v is None else float(v)
        if all(frames):
            keys = [c for c in (on if on is not None else self.labels) if c in a.columns and c in b.columns]
            right = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("value").alias("_v"))
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            df = a.join(right, same) if keys else a.crossJoin(right)
            df, x, y, kept = df, F.col("value"), F.col("_v"), [c for c in a.columns if c != "value"]
        else:
            df = a if frames[0] else b
            x, y, kept = (F.col("value"), F.lit(b), [c for c in a.columns if c != "value"]) if frames[0] else (F.lit(a), F.col("value"), [c for c in b.columns if c != "value"])
        if op in tests:
            test = tests[op](x, y)
            shown = F.col("value")
            return df.select(*kept, test.cast("double").alias("value")) if flag else df.where(test).select(*kept, shown.alias("value"))
        return df.select(*kept, sums[op](x, y).cast("double").alias("value"))

    def atom(self):
        t = self.peek()
        if t == "(":
            self.take()
            out = self.expression()
            self.take(")")
            return out
        if t == "{" or re.match(r"[A-Za-z_:]", t):
            after = self.tokens[self.i + 1] if self.i + 1 < len(self.tokens) else ""
            if t in (*_FOLDS, "topk", "bottomk", "quantile", "group") and after in ("(", "by", "without"):
                return self.aggregate()
            if after == "(" and t != "{":
                return self.call(self.take())
            return self.selector()
        try:
            return float(self.take())
        except ValueError:
            raise PromqlFault(f"not an expression: {t!r}") from None

    def matched(self) -> DataFrame:
        rows = self.samples
        if self.peek() != "{":
            rows = rows.where(F.col("name") == self.take())
        if self.peek() == "{":
            self.take()
            while self.peek() != "}":
                label, op, value = self.take(), self.take(), self.take()[1:-1]
                if label not in self.labels and label != "__name__":
                    raise PromqlFault(f"no label {label}")
                c = F.coalesce(F.col("name" if label == "__name__" else label).cast("string"), F.lit(""))
                test = c == value if op in ("=", "!=") else c.rlike(f"^(?:{value})$")
                rows = rows.where(test if op in ("=", "=~") else ~test)
                if self.peek() == ",":
                    self.take()
            self.take("}")
        return rows

    def offset(self) -> float:
        if self.peek() == "offset":
            self.take()
            return self.span(self.take())
        return 0.0

    def selector(self) -> DataFrame:
        rows = self.matched()
        if self.peek() == "[":
            raise PromqlFault("a range outside a function of ranges")
        end = self.at - self.offset()
        now = rows.where((F.col("t") <= end) & (F.col("t") > end - LOOKBACK))
        return now.groupBy(*self.labels).agg(F.max_by("value", "t").cast("double").alias("value"))

    def window(self) -> DataFrame:
        rows = self.matched()
        self.take("[")
        width = self.span(self.take())
        self.take("]")
        end = self.at - self.offset()
        return rows.where((F.col("t") <= end) & (F.col("t") > end - width)).withColumn("_width", F.lit(width))

    def call(self, name: str):
        self.take("(")
        if name in ("quantile_over_time",):
            q = self.expression()
            self.take(",")
            out = self.window().groupBy(*self.labels).agg(F.percentile("value", q).alias("value"))
        elif name.endswith("_over_time"):
            kind = name.removesuffix("_over_time")
            if kind not in (*_FOLDS, "last", "first"):
                raise PromqlFault(f"unknown function {name}")
            fold = F.max_by("value", "t") if kind == "last" else F.min_by("value", "t") if kind == "first" else _FOLDS[kind]("value")
            out = self.window().groupBy(*self.labels).agg(fold.cast("double").alias("value"))
        elif name in ("rate", "increase", "irate", "delta", "idelta", "deriv"):
            out = self.changes(name, self.window())
        elif name in _MAPS:
            out = self.mapped(self.expression(), _MAPS[name])
        elif name in ("clamp", "clamp_min", "clamp_max", "round"):
            v, limits = self.expression(), []
            while self.peek() == ",":
                self.take()
                limits.append(self.expression())
            if name == "round":
                step = limits[0] if limits else 1.0
                out = self.mapped(v, lambda x: F.floor(x / step + 0.5) * step)
            elif name == "clamp":
                out = self.mapped(v, lambda x: F.greatest(F.lit(limits[0]), F.least(F.lit(limits[1]), x)))
            else:
                out = self.mapped(v, lambda x: (F.greatest if name == "clamp_min" else F.least)(F.lit(limits[0]), x))
        elif name in ("label_replace", "label_join"):
            v, texts = self.expression(), []
            while self.peek() == ",":
                self.take()
                texts.append(self.take()[1:-1])
            out = self.labelled(name, v, texts)
        elif name in ("scalar", "vector", "time"):
            out = self.at if name == "time" else self.expression()
        else:
            raise PromqlFault(f"unknown function {name}")
        self.take(")")
        return out

    @staticmethod
    def mapped(v, fn):
        if not isinstance(v, DataFrame):
            raise PromqlFault("a vector is needed")
        return v.withColumn("value", fn(F.col("value")).cast("double"))

    def labelled(self, name: str, v: DataFrame, texts: list[str]) -> DataFrame:
        if name == "label_join":
            target, separator, *sources = texts
            return v.withColumn(target, F.concat_ws(separator, *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in sources]))
        target, to, source, pattern = texts
        old = F.coalesce(F.col(source).cast("string"), F.lit(""))
        kept = F.col(target).cast("string") if target in v.columns else F.lit(None).cast("string")
        return v.withColumn(target, F.when(old.rlike(f"^(?:{pattern})$"), F.regexp_replace(old, f"^(?:{pattern})$", to)).otherwise(kept))

    def changes(self, name: str, rows: DataFrame) -> DataFrame:
        """Counters count a fall as a reset to zero; rates are over the time between the first and last sample."""
        w = Window.partitionBy(*self.labels).orderBy("t")
        before, was = F.lag("value").over(w), F.lag("t").over(w)
        step = F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
        some = rows.select(*self.labels, "t", "value", before.alias("_b"), was.alias("_p"), step.alias("_s"))
        last = F.max_by(F.struct("value", "_b", "_s", "t", "_p"), "t")
        made = some.groupBy(*self.labels).agg(last.alias("l"), F.min_by("value", "t").alias("f"), F.min("t").alias("t0"), F.sum("_s").alias("s"), F.regr_slope("value", "t").alias("d"), F.count(F.lit(1)).alias("n")).where("n > 1")
        value: Column = {
            "rate": F.try_divide(F.col("s"), F.col("l.t") - F.col("t0")), "increase": F.col("s"), "irate": F.try_divide(F.col("l._s"), F.col("l.t") - F.col("l._p")),
            "delta": F.col("l.value") - F.col("f"), "idelta": F.col("l.value") - F.col("l._b"), "deriv": F.col("d"),
        }[name]
        return made.select(*self.labels, value.cast("double").alias("value"))

    def aggregate(self) -> DataFrame:
        kind, by = self.take(), None

        def clause() -> list[str] | None:
            if self.peek() not in ("by", "without"):
                return None
            which = self.take()
            some = self.names()
            return some if which == "by" else [c for c in self.labels if c not in some]

        by = clause()
        self.take("(")
        parameter = None
        if kind in ("topk", "bottomk", "quantile"):
            parameter = self.expression()
            self.take(",")
        v = self.expression()
        self.take(")")
        by = clause() if by is None else by
        by = [c for c in by or [] if c in v.columns]
        if kind in ("topk", "bottomk"):
            order = F.col("value").desc() if kind == "topk" else F.col("value").asc()
            w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
            return v.withColumn("_r", F.row_number().over(w.orderBy(order, *[c for c in v.columns if c != "value"]))).where(F.col("_r") <= int(parameter)).drop("_r")
        fold = F.percentile("value", parameter) if kind == "quantile" else F.lit(1.0) if kind == "group" else _FOLDS[kind]("value")
        return v.groupBy(*by).agg((F.max(F.lit(1.0)) if kind == "group" else fold).cast("double").alias("value"))


def run(text: str, samples: DataFrame, at: float) -> DataFrame:
    """The vector that an expression gives at an instant; a scalar is a row without labels."""
    e = _Eval(text, samples, at)
    out = e.expression()
    if e.peek():
        raise PromqlFault(f"unexpected {e.peek()!r}")
    return out if isinstance(out, DataFrame) else samples.sparkSession.createDataFrame([(float(out),)], "value double")
