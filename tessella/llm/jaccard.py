"""N-gram Jaccard self-join by count-vector R-trees.

A document's shingles are hashed into groups; the group counts are a point, and
the overlap of two documents is at most the sum of the coordinates' minima. The
number of groups follows the size, a half to all of it, above 512 a quarter to a
half; larger points fold onto smaller ones. R-trees over the points give the pairs whose bound reaches the
overlap that the similarity asks for, and surviving pairs are verified on the
sets themselves.

One tree over all documents would compare each query with most of its size
class, so the trees are partitioned: sets of the wanted similarity share one of
their first (1 - s) n + 1 shingles in any common order, so there is a tree for
each shingle of that prefix, and shingles with the same members are one tree. The
order puts frequent shingles last, by a count sketch of all documents. Members
without another of fitting size are left out. Equal sets are one node.

1. Nearest rounds. Each node asks the R-trees it shares most with for its nearest
   neighbour, and for the nearest of lower hash; verified, these pairs span most
   groups of near copies. ROUNDS times more each node asks ASKED of its trees of
   over SMALL nodes, if they still hold several components, for its nearest in
   another one.
2. Trees whose nodes still lie in several components are searched for all pairs
   of different components that the bound allows. Groups of over BLOCK nodes are
   searched in blocks; members of a tree's largest component are data only, never
   searched against each other. Near sets share many trees; a pair is left to the
   first of them, as far as the FIRST lowest trees of both nodes tell.
3. Survivors are verified in parts of at most about PAIRS pairs; links that join two
   components already joined there add nothing and aren't computed.

jaccard_join gives every document's component under all links; no link between
different components is lost. jaccard_links gives all links between different
sets instead, which needs no components and skips nothing. A null or empty text
has an empty set and is its own component. Repeated rows are equal sets, also
where they repeat an id with another text; extra columns are ignored. Nodes are
64-bit hashes of sets; that two different sets share one has a chance of 1e-8 in
a million sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import discard, materialise, released
from .components import components
from .shingles import mix, shingle_set

SKETCH = 1 << 20  # slots of the frequency sketch; its classes, one byte each, go to every task
PARTS = 256
BLOCK = 1024
LEAF = 16
ASKED = 2  # trees that a node asks for its nearest neighbour at first
SMALL = 64  # points that are compared as one leaf, without a tree above
ROUNDS = 1
PAIRS = 2048
FIRST = 16  # of a node's trees, those that each of its rows names in the search for all pairs
BITS = 1 << 26  # of the filter of wanted documents


def overlap_needed(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """Least intersection of sets of these sizes with 100 * common >= percent * union."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -((-percent * n) // 100) + 1


def node_of(tokens: np.ndarray) -> int:
    return int(mix(np.array([np.bitwise_xor.reduce(mix(tokens + np.uint64(1))) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def count_vector(tokens: np.ndarray) -> bytes:
    """Counts of the tokens' groups, a half to all of the tokens' number, above 512 a quarter to a half; a power of two, half a byte each."""
    groups = 16
    while (2 if len(tokens) <= 512 else 4) * groups < len(tokens):
        groups *= 2
    while True:
        counts = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups)
        if counts.max(initial=0) < 16:
            return (counts[0::2] << 4 | counts[1::2]).astype(np.uint8).tobytes()
        groups *= 2


def counts_of(vector: bytes) -> np.ndarray:
    packed = np.frombuffer(vector, np.uint8)
    out = np.empty(2 * len(packed), np.uint8)
    out[0::2], out[1::2] = packed >> 4, packed & 15
    return out


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.reshape(-1, groups).sum(0, dtype=np.int16) if len(counts) > groups else counts.astype(np.int16)


def _stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(lambda batches: released(run(batches)), schema)


def _slices(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step).to_pydict()


def _summaries(docs: DataFrame, width: int) -> DataFrame:
    """For each document its node, size and count vector; besides, each task's share of the frequency sketch."""

    def run(batches):
        load = np.zeros(SKETCH, np.int64)
        for rows in _slices(batches):
            out = {"doc_id": rows["doc_id"], "text_hash": rows["text_hash"], "node": [], "n": [], "vec": []}
            sets = [shingle_set(text, width) for text in rows["text"]]
            load += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            for tokens in sets:
                out["node"].append(node_of(tokens))
                out["n"].append(len(tokens))
                out["vec"].append(count_vector(tokens))
            none = [None] * len(out["n"])
            yield out | {"part": none, "load": none}
        if load.any():
            each = SKETCH // PARTS
            none = [None] * PARTS
            yield {"doc_id": none, "text_hash": none, "node": none, "n": none, "vec": none, "part": list(range(PARTS)), "load": [_packed(load[i * each : (i + 1) * each]) for i in range(PARTS)]}

    kind = dict(docs.dtypes)["doc_id"]
    return _stream(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run, f"doc_id {kind}, text_hash long, node long, n long, vec binary, part int, load binary")


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest of 1, 2, 4 or 8 bytes each."""
    most = counts.max(initial=0)
    return counts.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, {1: "u1", 2: "<u2", 4: "<u4", 8: "<u8"}[len(data) * PARTS // SKETCH]).astype(np.int64)


def _sketch_classes(parts: DataFrame) -> bytes:
    """The class of each slot: 0 up to 8 times the mean load, one more for each doubling."""

    def add(key, table):
        total = sum(_unpacked(x) for x in table.column("load").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "load": [_packed(total)]})

    form = "part int, salt int, load binary"
    some = parts.where("part IS NOT NULL").select("part", F.pmod(F.xxhash64("load"), F.lit(64)).cast("int").alias("salt"), "load")
    some = some.groupBy("part", "salt").applyInArrow(add, form).groupBy("part").applyInArrow(add, form)
    load = np.zeros(SKETCH, np.int64)
    each = SKETCH // PARTS
    for row in some.collect():  # 256 rows
        load[row["part"] * each : (row["part"] + 1) * each] = _unpacked(bytes(row["load"]))
    mean = max(load.mean(), 1.0)
    return np.clip(np.floor(np.log2(np.maximum(load, 1) / mean)) - 2, 0, 30).astype(np.uint8).tobytes()


def _postings(docs: DataFrame, width: int, percent: int, classes, buckets: int) -> DataFrame:
    """(token, node, n) of prefix shingles, tokens being 32 bits and a bucket number; nodes without another of fitting size are left out."""

    def emit(batches):
        level = np.frombuffer(classes.value, np.uint8)
        seen: set[int] = set()
        tokens, nodes, sizes, held = [], [], [], 0
        for rows in _slices(batches):
            for text in rows["text"]:
                found = shingle_set(text, width)
                if not len(found):
                    continue
                node = node_of(found)
                if node in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(node)
                grade = level[(found & np.uint64(SKETCH - 1)).astype(np.int64)]
                first = np.lexsort((found, grade))[: prefix_length(len(found), percent)]
                tokens.append(found[first])
                nodes.append(np.full(len(first), node, np.int64))
                sizes.append(np.full(len(first), len(found), np.int64))
                held += len(first)
            if held > 1_000_000:
                yield from flush(tokens, nodes, sizes, level)
                tokens, nodes, sizes, held = [], [], [], 0
        if held:
            yield from flush(tokens, nodes, sizes, level)

    def flush(tokens, nodes, sizes, level):
        tokens, nodes, sizes = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(sizes)
        mixed = mix(tokens)
        bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        short = (mixed & np.uint64(0xFFFFFFFF)).astype("<u4")
        grade = level[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.int64)
        # frequent shingles are dealt by node as well, so that none fills a task
        salt = np.where(grade > 2, 1 + (nodes & ((1 << np.minimum(grade, 16)) - 1)), 0)
        order = np.lexsort((short, salt, bucket))
        bucket, salt, short, nodes, sizes = bucket[order], salt[order], short[order], nodes[order], sizes[order].astype("<u4")
        cuts = np.flatnonzero(np.r_[True, (np.diff(bucket) != 0) | (np.diff(salt) != 0)])
        ends = np.r_[cuts[1:], len(bucket)]
        for i in range(0, len(cuts), 4096):
            b, e = cuts[i : i + 4096], ends[i : i + 4096]
            part = lambda c: [c[x:y].tobytes() for x, y in zip(b, e)]  # noqa: B023, E731
            yield {"bucket": bucket[b], "salt": salt[b], "tokens": part(short), "nodes": part(nodes), "sizes": part(sizes)}

    def gather(key, table):
        bucket, salt = (k.as_py() for k in key)
        tokens, nodes, sizes = (np.frombuffer(b"".join(table.column(c).to_pylist()), t).astype(np.int64) for c, t in (("tokens", "<u4"), ("nodes", "<i8"), ("sizes", "<u4")))
        order = np.lexsort((nodes, sizes, tokens))
        tokens, nodes, sizes = tokens[order], nodes[order], sizes[order]
        new = np.r_[True, (np.diff(tokens) != 0) | (np.diff(nodes) != 0)]
        tokens, nodes, sizes = tokens[new], nodes[new], sizes[new]
        if not salt:  # a salted share can't tell whether others have the token
            # in the order of size, one without a fitting neighbour has no partner at all
            fits = (np.diff(tokens) == 0) & (100 * sizes[:-1] >= percent * sizes[1:])
            kept = np.r_[False, fits] | np.r_[fits, False]
            tokens, nodes, sizes = tokens[kept], nodes[kept], sizes[kept]
        return pa.table({"token": tokens + (bucket << 32), "node": nodes, "n": sizes})

    blobs = _stream(docs.select("text"), emit, "bucket long, salt long, tokens binary, nodes binary, sizes binary")
    return blobs.groupBy("bucket", "salt").applyInArrow(gather, "token long, node long, n long")


def _wanted(spark, ids: DataFrame) -> bytes:
    """A bit filter of fixed size over the ids; it may let others pass."""
    slots = ids.select(F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(BITS)).alias("s")).distinct()
    each = BITS // 2048

    def bits(key, table):
        flags = np.zeros(each, np.uint8)
        flags[np.asarray(table.column("s")) % each] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": [np.packbits(flags).tobytes()]})

    found = slots.withColumn("part", F.expr(f"s div {each}")).groupBy("part").applyInArrow(bits, "part long, bits binary").collect()  # at most 2,048 rows of 4 KB
    out = bytearray(BITS // 8)
    for row in found:
        out[row["part"] * each // 8 : (row["part"] + 1) * each // 8] = row["bits"]
    return bytes(out)


def _sets(docs: DataFrame, reps: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, set) of the given nodes, from the texts again, which costs less than keeping every set."""
    spark = docs.sparkSession
    ids = materialise(reps.join(nodes, "node").select("rep", "node"))
    filter_ = spark.sparkContext.broadcast(_wanted(spark, ids.select("rep")))

    def run(batches):
        bits = np.frombuffer(filter_.value, np.uint8)
        for rows in _slices(batches):
            slots = np.array(rows["slot"], np.int64)
            chosen = np.flatnonzero(bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1)
            out = {"node": [], "set": []}
            for i in chosen:
                found = shingle_set(rows["text"][i], width)
                if len(found):
                    out["node"].append(node_of(found))
                    out["set"].append(found.tobytes())
            yield out

    slotted = docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("slot"))
    found = _stream(slotted, run, "node long, set binary")
    # the filter may pass more, and a repeated id more than one text
    return materialise(found.join(ids.select("node"), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set")))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, dict]]:
    """Rows of a partition sorted by its first `keys` columns, key by key."""
    key, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(i)) for i in range(keys)]
        turns = np.zeros(batch.num_rows, bool)
        for c in columns:
            turns[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(turns).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(int(c[a]) for c in columns)
            part = batch.slice(a, b - a)
            if now != key:
                if key is not None:
                    yield key, held
                key, held = now, [part]
            else:
                held.append(part)
    if key is not None:
        yield key, held


class RTree:
    """Count vectors in leaves of LEAF neighbours, each with coordinate maxima, least size, and least and greatest mark.

    A mark is a component, whose points then lie together, or a rank.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, marks: np.ndarray, together: bool = True):
        order = np.lexsort((points.argmax(1), sizes, marks)[: 3 if together else 2])
        self.order, top, low, first, last = order, points[order], sizes[order], marks[order], marks[order]
        self.levels = [(top, low, first, last)]
        while len(top) > LEAF or len(self.levels) == 1:
            cuts = np.arange(0, len(top), LEAF)
            top, low = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts)
            first, last = np.minimum.reduceat(first, cuts), np.maximum.reduceat(last, cuts)
            self.levels.append((top, low, first, last))

    def _below(self, found: np.ndarray, level: int) -> np.ndarray:
        found = (found[:, None] * LEAF + np.arange(LEAF)).ravel()
        return found[found < len(self.levels[level][0])]

    def search(self, point: np.ndarray, size: int, comp: int, percent: int) -> np.ndarray:
        """Positions of points of other components whose summed minima reach the overlap needed."""
        found = None
        for level in reversed(range(len(self.levels))):
            top, low, first, last = self.levels[level]
            found = np.arange(len(top)) if found is None else self._below(found, level)
            found = found[(first[found] != comp) | (last[found] != comp)]
            bound = np.minimum(top[found], point).sum(1)
            # the least size below a tree node asks for the least overlap
            found = found[bound >= overlap_needed(size, low[found], percent)]
            if not len(found):
                return found
        return self.order[found]

    def nearest(self, point: np.ndarray, size: int, mark: int, percent: int, lower: bool = False) -> tuple[int, int]:
        """The point of another mark, or of a lower one, whose bound exceeds the overlap needed by most: the excess and its position, (-1, -1) if there is none."""

        def excess(level: int, some: np.ndarray) -> np.ndarray:
            top, low, first, last = self.levels[level]
            fits = first[some] < mark if lower else (first[some] != mark) | (last[some] != mark)
            return np.where(fits, np.minimum(top[some], point).sum(1) - overlap_needed(size, low[some], percent), -1)

        height = len(self.levels) - 1
        highest = np.arange(len(self.levels[height][0]))
        promise = excess(height, highest)
        # down the most promising way first, then only where more is promised
        some, way = highest, promise
        for level in reversed(range(height)):
            if way.max() < 0:
                return -1, -1
            some = self._below(some[[way.argmax()]], level)
            way = excess(level, some)
        best, where = int(way.max()), int(some[way.argmax()])
        some = highest[promise > best]
        for level in reversed(range(height)):
            if not len(some):
                break
            some = self._below(some, level)
            way = excess(level, some)
            some, way = some[way > best], way[way > best]
        else:
            if len(some):
                best, where = int(way.max()), int(some[way.argmax()])
        return (best, int(self.order[where])) if best >= 0 else (-1, -1)


def _close(points, n, comp, left, right, percent) -> Iterator[tuple[int, int]]:
    """Pairs of left and right rows of different components whose bound reaches the overlap needed."""
    if not len(left) or not len(right):
        return
    if len(left) * len(right) <= SMALL * SMALL:  # one leaf
        a, b = (np.stack([points[int(k)] for k in some]) for some in (left, right))
        bound = np.minimum(a[:, None], b[None]).sum(2)
        need = overlap_needed(n[left][:, None], n[right][None], percent)
        x, y = np.nonzero((bound >= need) & (comp[left][:, None] != comp[right][None]))
        yield from zip(left[x], right[y])
        return
    tree = RTree(np.stack([points[int(k)] for k in right]), n[right], comp[right])
    for x in left:
        for y in right[tree.search(points[int(x)], n[x], comp[x], percent)]:
            yield x, y


def _classes(table: pa.Table, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]]:
    """For each number of groups: rows with so many, rows with more whose sizes still allow a link, and the points of both, folded."""
    vectors = [counts_of(v) for v in table.column("vec").to_pylist()]
    lengths = np.array([len(v) for v in vectors])
    for groups in np.unique(lengths):
        own = np.flatnonzero(lengths == groups)
        more = np.flatnonzero((lengths > groups) & (percent * n <= 100 * n[own].max()))
        yield own, more, {int(k): folded(vectors[k], int(groups)) for k in np.concatenate([own, more])}


def _nearest(rows: DataFrame, percent: int, lower: bool) -> DataFrame:
    """rows (g, i, node, comp, n, vec) to (a, b, excess): of each node b and block (g, i) the nearest node a of another component.

    lower: also the nearest of lower hash.
    """

    def run(batches):
        out = {"a": [], "b": [], "excess": [], "low": []}
        for _, parts in _runs(batches, 2):
            table = pa.Table.from_batches(parts)
            node, comp, n = (np.asarray(table.column(k)) for k in ("node", "comp", "n"))
            if comp.min() == comp.max():
                continue
            marks = [(comp, False), (np.argsort(np.argsort(node)), True)][: 1 + lower]
            best, lead = np.full((2, len(node)), -1), np.full((2, len(node)), -1)
            for own, more, points in _classes(table, n, percent):
                both = np.concatenate([own, more])
                if len(both) == 1:
                    continue
                at = np.stack([points[int(k)] for k in both])
                if len(both) <= SMALL:  # one leaf
                    over = np.minimum(at[:, None], at[None]).sum(2) - overlap_needed(n[both][:, None], n[both][None], percent)
                    for turn, (mark, low) in enumerate(marks):
                        m = mark[both]
                        fits = np.where(m[None] < m[:, None] if low else m[None] != m[:, None], over, -1)
                        y = fits.argmax(1)
                        most = fits[np.arange(len(both)), y]
                        won = most > best[turn][both]
                        best[turn][both[won]], lead[turn][both[won]] = most[won], both[y[won]]
                    continue
                for turn, (mark, low) in enumerate(marks):
                    tree = RTree(at, n[both], mark[both], together=not low)
                    for k, x in enumerate(both):
                        excess, y = tree.nearest(at[k], n[x], mark[x], percent, low)
                        if excess > best[turn][x]:
                            best[turn][x], lead[turn][x] = excess, both[y]
            for turn in range(len(marks)):
                some = np.flatnonzero(lead[turn] >= 0)
                for k, v in zip(out, (node[lead[turn][some]], node[some], best[turn][some], np.full(len(some), turn))):
                    out[k] += v.tolist()
            if len(out["a"]) > 20_000:
                yield out
                out = {k: [] for k in out}
        yield out

    dealt = rows.select("g", "i", "node", "comp", "n", "vec").repartition("g", "i").sortWithinPartitions("g", "i")
    return _stream(dealt, run, "a long, b long, excess long, low int")


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """rows (g, i, j, side, node, comp, n, vec, first) to pairs (g, i, j, a, b) that the bound allows.

    first: the lowest trees of the node. All trees below one of them that two nodes have in common are among both their lists, so the
    lowest of those is the lowest that holds the pair; trees above it leave the pair out. Without a common one every tree gives the pair.
    """

    def run(batches):
        out = {k: [] for k in ("g", "i", "j", "a", "b")}
        for (g, i, j), parts in _runs(batches, 3):
            table = pa.Table.from_batches(parts)
            node, comp, n, side = (np.asarray(table.column(k)) for k in ("node", "comp", "n", "side"))
            if comp.min() == comp.max() or 100 * n.max() < percent * n.min():
                continue
            lower = [{t for t in some if t < g} for some in table.column("first").to_pylist()]
            on = lambda some, at: some[side[some] == at] if i != j else some  # noqa: B023, E731
            for own, more, points in _classes(table, n, percent):
                for left, right in ((on(own, 0), on(own, 1)), (on(own, 0), on(more, 1)), (on(more, 0), on(own, 1)))[: 3 if i != j else 2]:
                    for x, y in _close(points, n, comp, left, right, percent):
                        if (i != j or left is own and right is more or node[x] < node[y]) and lower[x].isdisjoint(lower[y]):
                            for k, v in zip(out, (g, i, j, *sorted((int(node[x]), int(node[y]))))):
                                out[k].append(v)
            if len(out["g"]) > 20_000:
                yield out
                out = {k: [] for k in out}
        yield out

    dealt = rows.select("g", "i", "j", "side", "node", "comp", "n", "vec", "first").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return _stream(dealt, run, "g long, i long, j long, a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, joining: bool = True) -> DataFrame:
    """pairs (g, i, j, a, b) to verified links (a, b); joining: within each (g, i, j) no more than join its components."""
    keys = ["g", "i", "j"]
    members = pairs.select(*keys, F.explode(F.array("a", "b")).alias("a")).distinct()
    sides = members.join(sets.select(F.col("node").alias("a"), "set"), "a").select(*keys, F.lit(0).alias("kind"), "a", F.lit(None).cast("long").alias("b"), "set")
    both = sides.unionByName(pairs.select(*keys, F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("set")))

    def run(batches):
        for _, parts in _runs(batches, 3):
            found, up = {}, {}
            out = {"a": [], "b": []}

            def root(x):
                while up.get(x, x) != x:
                    up[x] = x = up.get(up[x], up[x])
                return x

            for part in parts:
                for a, b, data in zip(*(part.column(part.schema.get_field_index(k)).to_pylist() for k in ("a", "b", "set"))):
                    if b is None:
                        found[a] = np.frombuffer(data, np.uint64)
                        continue
                    ra, rb = root(a), root(b)
                    if joining and ra == rb:
                        continue
                    x, y = found[a], found[b]
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        up[ra] = rb
                        out["a"].append(a)
                        out["b"].append(b)
            yield out

    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "kind")
    return materialise(_stream(dealt, run, "a long, b long"))


class _Nodes:
    """The distinct sets of documents: rows (doc_id, node, n), reps (node, rep, n), and nodes (node, n, vec)."""

    def __init__(self, docs: DataFrame, percent: int, width: int):
        self.docs, self.percent, self.width = docs.select("doc_id", "text"), percent, width
        summary = materialise(_summaries(self.docs, width))
        self.rows = summary.where("part IS NULL").select("doc_id", "text_hash", "node", "n")
        self.full = self.rows.where("n > 0")
        self.reps = materialise(self.full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")))
        self.nodes = materialise(summary.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("vec").alias("vec")))
        self.total = self.reps.agg(F.sum("n")).first()[0] or 0
        self.summary = summary

    def trees(self) -> DataFrame:
        """(g, m, weight, node, n): the members of each tree g, their number, and how many shingles have just these members."""
        classes = self.docs.sparkSession.sparkContext.broadcast(_sketch_classes(self.summary))
        buckets = max(64, math.ceil(self.total * (100 - self.percent) / 100 / 200_000))
        post = materialise(_postings(self.docs, self.width, self.percent, classes, buckets))
        members = post.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("m > 1")
        trees = members.groupBy("m", "x", "y").agg(F.min("token").alias("g"), F.count(F.lit(1)).alias("weight")).select("g", "m", "weight")
        out = materialise(post.join(trees, post["token"] == trees["g"]).select("g", "m", "weight", "node", "n"))
        discard(post)
        return out

    def points(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.nodes.select("node", "vec"), "node")

    def verified(self, pairs: DataFrame, joining: bool = True) -> DataFrame:
        """Links among pairs (g, a, b), of which those of one g are verified together, in several parts where they are many."""
        # only groups of over PAIRS pairs are listed, so the list is short; it is broadcast, and the pairs stay where they are
        some = pairs.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / PAIRS).alias("k")).where("k > 1")
        parts = pairs.join(F.broadcast(some), "g", "left").select("g", F.pmod(F.xxhash64("a", "b"), F.coalesce("k", F.lit(1))).alias("i"), F.lit(0).cast("long").alias("j"), "a", "b")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = _sets(self.docs, self.reps, ends, self.width)
        out = _verified(parts, sets, self.percent, joining)
        discard(pairs, sets)
        return out

    def nearest(self, rows: DataFrame, turn: int) -> DataFrame:
        """Verified links of each node in rows (g, m, node, n, comp) to its nearest in another component, at first also to that of lower hash."""
        blocks = F.pmod(F.xxhash64("node", "g", F.lit(turn)), F.ceil(F.col("m") / BLOCK)).cast("long")
        pairs = _nearest(self.points(rows.withColumn("i", blocks)), self.percent, turn == 0)
        pairs = pairs.groupBy("b", "low").agg(F.max(F.struct("excess", "a")).alias("top")).select(F.least("top.a", "b").alias("a"), F.greatest("top.a", "b").alias("b"), F.col("top.a").alias("g"))
        # a node that many have as their nearest is verified with all of them
        return self.verified(materialise(pairs.groupBy("a", "b").agg(F.min("g").alias("g"))))

    def searched(self, rows: DataFrame, trees: DataFrame) -> DataFrame:
        """All pairs (g, i, j, a, b) of different components in rows (g, node, n, comp, own, blocks..) that the bound allows, each once.

        trees: (g, node), the members of all trees that rows has.
        """
        first = trees.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("g")), 1, FIRST).alias("first"))
        # a pair that several trees still give is verified once
        return materialise(_candidates(self.points(rows).join(first, "node"), self.percent).groupBy("a", "b").agg(F.min(F.xxhash64("g", "i", "j")).alias("g")))


def _blocks(rows: DataFrame, members: Column, start: Column, against: Column) -> DataFrame:
    """rows dealt to `members` / BLOCK blocks, numbered from start, each block beside the blocks numbered from 0 to against - 1 and itself."""
    own = start + F.pmod(F.xxhash64("node", "g"), F.greatest(F.ceil(members / BLOCK), F.lit(1)))
    rows = rows.withColumn("own", own.cast("long"))
    beside = F.array_union(F.array("own"), F.sequence(F.lit(0).cast("long"), against.cast("long") - 1))
    return rows.withColumn("other", F.explode(beside))


def jaccard_join(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Besides, a hash of the text and class_id, which tells components apart also where ids are null or repeat; null for empty sets.
    """
    found = _Nodes(docs, percent, width)
    rows, full, reps = found.rows, found.full, found.reps
    if not found.total:
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("long").alias("class_id"))
    comp = components(_links(found))
    labels = reps.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = labels.groupBy("comp").agg(F.min("rep").alias("component_id"))
    labels = materialise(labels.join(least, "comp").select("node", "component_id", F.col("comp").alias("class_id")))
    linked = full.join(labels, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_hash", "class_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("long").alias("class_id"))
    discard(found.nodes, reps, comp)
    return linked.unionByName(alone)


def nearest_links(found: _Nodes, trees: DataFrame) -> DataFrame:
    """Verified links of each node to the nearest in the ASKED trees whose members share most shingles."""
    most = Window.partitionBy("node").orderBy(F.desc(F.col("weight") * F.log2("m")), "g")
    asked = trees.withColumn("k", F.row_number().over(most)).where(F.col("k") <= ASKED)
    return found.nearest(asked.withColumn("comp", F.col("node")), 0)


def _labelled(trees: DataFrame, links: DataFrame) -> DataFrame:
    """Members (g, m, node, n, comp) of the trees that hold several components under links."""
    comp = components(links)
    rows = trees.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).select("g", "m", "node", "n", "comp")
    mixed = rows.groupBy("g").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c <> d").select("g")
    out = materialise(rows.join(mixed, "g"))
    discard(comp)
    return out


def _links(found: _Nodes) -> DataFrame:
    trees = found.trees()
    links = nearest_links(found, trees)
    rows = _labelled(trees, links)
    for turn in range(1, ROUNDS + 1):
        some = Window.partitionBy("node").orderBy(F.xxhash64("g", F.lit(turn)))
        large = rows.where(F.col("m") > SMALL).withColumn("k", F.row_number().over(some)).where(F.col("k") <= ASKED).drop("k")
        new = found.nearest(large, turn) if large.take(1) else None
        if new is None:
            break
        links = links.unionByName(new)
        old, rows = rows, _labelled(rows.select("g", "m", "node", "n"), links)
        discard(old)
    sizes = rows.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("c"))
    trees_left = sizes.groupBy("g").agg(F.count(F.lit(1)).alias("comps"), F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top")).where("comps > 1")
    left = rows.drop("m").join(trees_left.select("g", "m", F.col("top.c").alias("large"), F.col("top.comp").alias("largest")), "g")
    # blocks of other members come first; members of a large largest component are beside those only
    small = F.greatest(F.ceil((F.col("m") - F.col("large")) / BLOCK), F.lit(1))
    split = F.col("m") > BLOCK
    is_data = split & (F.col("comp") == F.col("largest"))
    queries = _blocks(left.where(~is_data), F.when(split, F.col("m") - F.col("large")).otherwise(F.lit(1)), F.lit(0), F.when(split, small + F.ceil(F.col("large") / BLOCK)).otherwise(F.lit(1)))
    data = _blocks(left.where(is_data), F.col("large"), small, small)
    data = data.where("own <> other")
    both = queries.unionByName(data).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", (F.col("own") == F.col("j")).cast("int"))
    more = found.verified(found.searched(both, rows))
    discard(trees, rows)
    return links.unionByName(more)


def jaccard_links(docs: DataFrame, percent: int = 75, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """All links of different sets as (a, b), the smallest doc_ids of each, a < b; and membership (doc_id, rep), n_shingles of every row.

    The work grows with the number of links: m near copies that all differ have m * m / 2 of them. Rows with an empty set have rep null.
    """
    found = _Nodes(docs, percent, width)
    membership = found.rows.join(found.reps.select("node", "rep"), "node", "left").select("doc_id", "rep", F.col("n").alias("n_shingles"))
    if not found.total:
        return membership.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0), membership
    trees = found.trees().select("g", "m", "node", "n", F.col("node").alias("comp"))
    rows = _blocks(trees, F.col("m"), F.lit(0), F.ceil(F.col("m") / BLOCK))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", (F.col("own") == F.col("j")).cast("int"))
    links = found.verified(found.searched(rows, trees), joining=False)
    of = lambda side: found.reps.select(F.col("node").alias(side), F.col("rep").alias(f"rep_{side}"))
    links = links.join(of("a"), "a").join(of("b"), "b")
    return links.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")), membership
