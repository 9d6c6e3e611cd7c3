"""Sharding along a Hilbert curve, in DataFrame expressions only.

Several metadata dimensions are quantised to BITS bits each by their own
quantiles, so every cell holds a like share of the rows: sizes and ids by
approximate percentiles, languages and sources by their rows' cumulative share in
code-point order. The point's index on the Hilbert curve gives the order, and the
order is cut into runs of equal row counts (at most one apart). Rows near each
other in all dimensions so share files, whose column ranges then prune filters on
any of them.

Ranks need no single task: rows of 4,096 stretches of the curve are counted, and
within each stretch rows of each point and of hash ranges at that point. There
are 64 of these, more where the table has over 64 * 4,194,304 rows, so a range
has that many rows at most, however many a point holds. Rows are numbered only
within one such range.

Null languages and sources are labels of their own, null ids the first cell, null
texts have size 8. Repeated rows take neighbouring places, which one is arbitrary
among equals. Extra columns are ignored. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

BITS = 6
DIMS = 4
STRETCH = 12  # leading bits of the index
RANGES = 64
RANGE_ROWS = 1 << 22


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """The Hilbert index of a point with non-negative coordinates below 2**bits.

    Per level, from the top: a set bit flips the lower bits of the first axis, an
    unset one swaps them with those of the axis; a Gray code then gives the order.
    """
    n = len(axes)
    xor, bit = lambda a, b: a.bitwiseXOR(b), lambda a, b: a.bitwiseAND(b)
    steps = F.array(*[F.struct(F.lit((1 << q) - 1).alias("low"), F.lit(1 << q).alias("bit"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, step: Column) -> Column:
        mine = F.get(x, step["i"])
        first = F.get(x, F.lit(0))
        swap = bit(xor(first, mine), step["low"])
        new_first = F.when(bit(mine, step["bit"]) != 0, xor(first, step["low"])).otherwise(xor(first, swap))
        new_mine = F.when(bit(mine, step["bit"]) != 0, mine).otherwise(xor(mine, swap))
        return F.transform(x, lambda v, k: F.when(k == 0, new_first).when(k == step["i"], new_mine).otherwise(v))

    turned = F.aggregate(steps, F.array(*[a.cast("int") for a in axes]), turn)

    def coded(x: Column) -> Column:
        gray = F.aggregate(
            F.slice(x, 2, n - 1), F.slice(x, 1, 1), lambda acc, v: F.concat(acc, F.array(xor(v, F.element_at(acc, -1))))
        )
        flips = F.array(*[F.lit(1 << q) for q in range(bits - 1, 0, -1)])
        t = F.aggregate(flips, F.lit(0), lambda acc, q: F.when(bit(F.element_at(gray, -1), q) != 0, xor(acc, q - F.lit(1))).otherwise(acc))
        return F.transform(gray, lambda v: xor(v, t))

    places = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, -1, -1) for i in range(n)])

    def weave(x: Column) -> Column:
        put = lambda acc, p: acc * F.lit(2).cast("long") + F.call_function("shiftright", F.get(x, p["i"]), p["q"]).bitwiseAND(F.lit(1)).cast("long")
        return F.aggregate(places, F.lit(0).cast("long"), put)

    # one-element arrays bind each stage's result, so that no expression is repeated in the plan
    staged = F.transform(F.transform(F.array(turned), coded), weave)
    return F.element_at(staged, 1)


def _label_cells(rows: DataFrame, name: str, total: int) -> DataFrame:
    """(name, cell): labels in order, each at the share of rows before it."""
    counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(F.col(name).alias(f"_{name}"), F.floor(before * (1 << BITS) / total).cast("int").alias(f"_cell_{name}"))


def _number_cell(c: Column, cuts: list) -> Column:
    """How many cuts lie below c."""
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in cuts]), lambda x: x < c)) if cuts else F.lit(0)


def located(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (doc_id, size, lang, source, ..) with column curve, and their number. rows are read several times."""
    shares = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.col(c).cast("long"), shares).alias(c) for c in ("size", "doc_id")]).first()
    total = found["n"]
    size, age = (_number_cell(F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)).cast("long")), found[c]) for c in ("size", "doc_id"))
    for name in ("lang", "source"):
        cells = _label_cells(rows, name, max(total, 1))
        rows = rows.join(cells, F.col(name).eqNullSafe(F.col(f"_{name}")), "left")
    axes = [F.coalesce("_cell_lang", F.lit(0)), F.coalesce("_cell_source", F.lit(0)), size, age]
    return rows.withColumn("curve", hilbert_index(axes)).drop("_lang", "_source", "_cell_lang", "_cell_source"), total


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve index."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    narrow = materialise(rows)
    rows, count = located(narrow)
    ranges = RANGES
    while ranges * RANGE_ROWS < count:
        ranges *= 2
    rows = rows.drop("lang", "source")
    spread = F.xxhash64("doc_id", "text_crc32")
    low = F.col("curve").bitwiseAND(F.lit((1 << (BITS * DIMS - STRETCH)) - 1))
    rows = rows.withColumn("_stretch", F.shiftright("curve", BITS * DIMS - STRETCH).cast("int")).withColumn("_range", low * ranges + F.pmod(spread, F.lit(ranges)))
    rows = materialise(rows)
    discard(narrow)

    fine = rows.groupBy("_stretch", "_range").agg(F.count(F.lit(1)).alias("_n"))
    coarse = fine.groupBy("_stretch").agg(F.sum("_n").alias("_all"))
    before = F.sum("_all").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_all").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    coarse = coarse.select("_stretch", F.coalesce(before, F.lit(0)).alias("_before"), total.alias("_total"))
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy("_stretch").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(fine.withColumn("_inner", inner).join(coarse, "_stretch").select("_stretch", "_range", (F.col("_before") + F.col("_inner")).alias("_start"), "_total"))

    number = F.row_number().over(Window.partitionBy("_stretch", "_range").orderBy("curve", "doc_id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("_number", number).join(starts, ["_stretch", "_range"]).withColumn("_rank", F.col("_start") + F.col("_number"))
    # the first (total % shards) shards hold one row more
    least, more = F.expr(f"_total div {shards}"), F.expr(f"_total % {shards}")
    big = (least + 1) * more
    where = F.when(F.col("_rank") < big, F.expr(f"_rank div (_total div {shards} + 1)")).otherwise(more + F.expr(f"try_divide(_rank - (_total div {shards} + 1) * (_total % {shards}), _total div {shards})").cast("long"))
    ranked = ranked.withColumn("shard", where.cast("int"))
    first = F.col("shard") * least + F.least(F.col("shard").cast("long"), more)
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
