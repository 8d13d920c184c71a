"""Hard negatives from a multiway hyperplane tree over vectors (GNAT).

Scores are integer inner products. With one more coordinate, ``sqrt(M^2 - |x|^2)`` for the longest vector's M, all rows
have the same length, so a score is a Euclidean distance to the query and a window of scores is an annulus. A node of the
tree has some split points; a row goes to the child of the nearest one. Every split point knows the least and
greatest distance to the rows of every child, its own and its siblings': a child whose range does not meet what the
annulus allows holds no answer. Leaves are searched exactly, in blocks of bounded size: the rows of a block and the
queries that reach it are one sorted stream. The tree is fitted on a bounded sample; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from txrisk.session import scratch_path

#: Components beyond this are cut to it, so that a score of up to 500 of them fits 64 bits.
MOST = 2**27
_LOW, _HIGH = -(2**62), 2**62


@dataclass(frozen=True)
class HyperplaneTree:
    """``sample`` rows (smallest hash) fit the tree, which has ``max_leaves`` leaves at most; all rows are indexed."""

    arity: int = 8
    leaf_rows: int = 4096
    block_rows: int = 8192
    sample: int = 8192
    max_leaves: int = 512
    queries_at_once: int = 256


@dataclass(frozen=True)
class Mining:
    """Bounds of a negative's score in hundredths of the positive's, and how many of each are taken."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


@dataclass
class Node:
    """Split points (lifted), children and, for [child, split point], the range of distances."""

    points: np.ndarray
    children: list[int]
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0))


# Children are node numbers from 0, or leaves as -1 - leaf.
Tree = list[Node]


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", x, x), 0.0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _far_points(x: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other, greedily; fewer where rows coincide."""
    picked = [int(np.argmax(_distances(x, x.mean(axis=0, keepdims=True))[:, 0]))]
    nearest = _distances(x, x[picked])[:, 0]
    while len(picked) < count and nearest.max() > 1e-6 * (1 + np.abs(x).max()):
        picked.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, _distances(x, x[picked[-1:]])[:, 0])
    return np.array(picked)


def build_tree(sample: np.ndarray, rows: int, longest: float, params: HyperplaneTree) -> Tree:
    """Split the sample until a leaf's share of the rows is small, or leaves run out; at least one node."""
    lifted = _lift(sample, longest)
    leaves = max(2, min(params.max_leaves, -(-rows // params.leaf_rows)))
    tree: Tree = []
    todo = [(np.arange(len(lifted)), None, 0)]
    made = 0
    while todo:
        # The fullest part is split first.
        todo.sort(key=lambda part: len(part[0]))
        members, parent, child = todo.pop()
        share = len(members) * rows / max(len(lifted), 1)
        points = np.zeros(0, dtype=int)
        if len(members) > 1 and (parent is None or (share > params.leaf_rows and made + len(todo) + 1 < leaves)):
            points = _far_points(lifted[members], min(params.arity, leaves - made - len(todo) if parent is not None else params.arity))
        if len(points) > 1 or parent is None:
            chosen = lifted[members[points]] if len(points) else lifted[members[:1]]
            tree.append(Node(chosen, [0] * max(len(chosen), 1)))
            name = len(tree) - 1
            if parent is not None:
                tree[parent].children[child] = name
            near = np.argmin(_distances(lifted[members], chosen), axis=1) if len(chosen) else np.zeros(0, dtype=int)
            todo += [(members[near == i], name, i) for i in range(max(len(chosen), 1))]
        else:
            tree[parent].children[child] = -1 - made
            made += 1
    return tree


def _descend(tree: Tree, lifted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, rows there, their distances to its split points, child of each), every node that a row passes."""
    at = np.zeros(len(lifted), dtype=int)
    while True:
        inner = at >= 0
        if not inner.any():
            return
        for node in np.unique(at[inner]):
            here = np.flatnonzero(at == node)
            far = _distances(lifted[here], tree[node].points)
            child = np.argmin(far, axis=1)
            yield int(node), here, far, child
            at[here] = np.array(tree[node].children)[child]


def _leaf_of(tree: Tree, lifted: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lifted), dtype=int)
    for node, here, _, child in _descend(tree, lifted):
        out[here] = np.array(tree[node].children)[child]
    return -1 - out


def reached(tree: Tree, query: np.ndarray, longest: float, windows: list[tuple[int, int]]) -> list[int]:
    """Leaves that may hold a row whose score with the query lies in one of the windows."""
    windows = [(lo, hi) for lo, hi in windows if lo <= hi]
    square = float(query @ query) + longest
    slack = 1e-6 * (1.0 + np.sqrt(square))
    r1 = np.array([np.sqrt(max(square - 2.0 * hi, 0.0)) for _, hi in windows]) - slack
    r2 = np.array([np.sqrt(max(square - 2.0 * lo, 0.0)) for lo, _ in windows]) + slack
    out = []
    todo = [(0, np.arange(len(windows)))]
    lifted = np.append(query.astype(np.float64), 0.0)[None, :]
    while todo:
        node, open_ = todo.pop()
        if node < 0:
            out.append(-1 - node)
            continue
        far = _distances(lifted, tree[node].points)[0]
        least = np.maximum(far[None, :] - r2[open_, None], r1[open_, None] - far[None, :])
        most = far[None, :] + r2[open_, None]
        for child, below in enumerate(tree[node].children):
            meets = (tree[node].high[child] >= least) & (tree[node].low[child] <= most)
            left = open_[meets.all(axis=1)]
            if len(left):
                todo.append((below, left))
    return out


# ---- rows in and out of arrow --------------------------------------------------------------


def _batch(columns: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrays of integers as rows of a matrix, missing components zero."""
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, dtype=np.int64)
    lengths = np.diff(offsets)
    out = np.zeros((len(column), width), dtype=np.int64)
    if len(column) and (lengths == width).all():
        return flat.reshape(len(column), width).astype(np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles where no sum can leave their integers."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def usable_rows(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """id, label, v: rows with an id, a label and a vector of finite components, as integers ``floor(scale * x)``."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    kept = embeddings.where("vec_id is not null and label is not null and embedding is not null").where(finite)

    def whole(c: Column) -> Column:
        scaled = F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST))))
        return scaled.cast("int")

    return kept.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform(x, whole).alias("v"))


@dataclass
class Index:
    """Rows with their leaf and block in a shared table, the tree with its ranges, and the fitted sample."""

    rows: DataFrame
    blocks: DataFrame
    tree: Tree
    width: int
    longest: float
    sample_id: np.ndarray
    sample_label: np.ndarray
    sample: np.ndarray


def build_index(rows: DataFrame, params: HyperplaneTree | None = None) -> Index | None:
    """Index every row of ``rows(id, label, v)``; None for an empty table."""
    p = params or HyperplaneTree()
    spark = rows.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    path = scratch_path(spark, "vectors")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    total = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(square).alias("longest")).first()
    if not total["n"]:
        return None
    width, longest = total["width"], total["longest"] * (1 + 1e-12)
    fitted = rows.orderBy(F.xxhash64("id"), "id", "label", "v").limit(p.sample).toArrow()
    sample = _matrix(fitted.column("v").combine_chunks(), width)
    tree = build_tree(sample, total["n"], longest, p)
    placed = to_arrow_schema(StructType.fromDDL("id long, label long, v array<int>, leaf int"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = _leaf_of(tree, _lift(_matrix(b.column("v"), width), longest))
            yield _batch([b.column(0), b.column(1), b.column(2), pa.array(leaf)], placed)

    leaves = rows.mapInArrow(place, "id long, label long, v array<int>, leaf int")
    path = scratch_path(spark, "vectors-placed")
    leaves.write.parquet(path)
    leaves = spark.read.parquet(path)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = [np.full((len(n.children), len(n.points)), np.inf) for n in tree]
        high = [np.full((len(n.children), len(n.points)), -np.inf) for n in tree]
        for b in batches:
            for node, _, far, child in _descend(tree, _lift(_matrix(b.column("v"), width), longest)):
                np.minimum.at(low[node], child, far)
                np.maximum.at(high[node], child, far)
        out = [(i, c, low[i][c].tolist(), high[i][c].tolist()) for i, n in enumerate(tree) for c in range(len(n.children))]
        yield pa.RecordBatch.from_pylist([dict(zip(("node", "child", "low", "high"), r)) for r in out if np.isfinite(r[2]).all()], schema=ranged)

    ranges_ddl = "node int, child int, low array<double>, high array<double>"
    ranged = to_arrow_schema(StructType.fromDDL(ranges_ddl))
    parts = leaves.select("v").mapInArrow(measure, ranges_ddl)
    each = parts.select("node", "child", F.posexplode(F.arrays_zip("low", "high")).alias("split", "r")).groupBy("node", "child", "split")
    # As many numbers as the tree has children times split points.
    found = each.agg(F.min("r.low").alias("low"), F.max("r.high").alias("high")).collect()
    for n in tree:
        # A child without rows has a range that nothing meets.
        n.low = np.full((len(n.children), len(n.points)), np.inf)
        n.high = np.full((len(n.children), len(n.points)), -np.inf)
    for r in found:
        tree[r["node"]].low[r["child"], r["split"]] = r["low"]
        tree[r["node"]].high[r["child"], r["split"]] = r["high"]
    # A leaf of any size is cut into blocks; the leaves are bounded, so is this table.
    sizes = {r["leaf"]: r["count"] for r in leaves.groupBy("leaf").count().collect()}
    blocks = {leaf: -(-n // p.block_rows) for leaf, n in sizes.items()}
    table = spark.createDataFrame(sorted(blocks.items()), "leaf int, blocks int")
    cut = leaves.join(F.broadcast(table), "leaf").withColumn("block", F.pmod(F.monotonically_increasing_id(), F.col("blocks")).cast("int"))
    path = scratch_path(spark, "vectors-index")
    cut.drop("blocks").write.parquet(path)
    return Index(
        spark.read.parquet(path), table, tree, width, longest, np.asarray(fitted.column("id")), np.asarray(fitted.column("label")), sample
    )


_QUERY = "key long, id long, label long, v array<int>, windows array<struct<no:int,low:long,high:long>>"
_FOUND = "key long, no int, found_id long, score long"


def search(index: Index, queries: DataFrame, take: int, same_label: bool, params: HyperplaneTree | None = None) -> DataFrame:
    """key, no, found_id, score, rank: the best ``take`` rows of every window of every query, exactly.

    ``queries(key, id, label, v, windows)``: a window is a number and inclusive bounds of the score. Rows found have
    the query's label, or another one, and another id than the query. A bound that the sample proves is used to rule
    out leaves: ``take`` rows of the sample at or above a score leave nothing below it to be found.
    """
    p = params or HyperplaneTree()
    tree, width, longest, sample, sample_id, sample_label = (
        index.tree, index.width, index.longest, index.sample, index.sample_id, index.sample_label
    )
    routed_ddl = _QUERY + ", leaf int"
    routed = to_arrow_schema(StructType.fromDDL(routed_ddl))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, p.queries_at_once):
                b = whole.slice(start, p.queries_at_once)
                q = _matrix(b.column("v"), width)
                near = scores(q, sample)
                take_from, leaves, windows = [], [], []
                ids, labels, asked = b.column("id").to_pylist(), b.column("label").to_pylist(), b.column("windows").to_pylist()
                for i in range(len(q)):
                    fits = (sample_id != ids[i]) & ((sample_label == labels[i]) == same_label)
                    mine = np.sort(near[i][fits])[::-1]
                    narrowed = []
                    for w in asked[i]:
                        within = mine[np.searchsorted(-mine, -w["high"], "left") :]
                        low = max(w["low"], int(within[take - 1])) if len(within) >= take else w["low"]
                        narrowed.append({"no": w["no"], "low": low, "high": w["high"]})
                    to = reached(tree, q[i].astype(np.float64), longest, [(w["low"], w["high"]) for w in narrowed])
                    take_from += [i] * len(to)
                    leaves += to
                    windows += [narrowed] * len(to)
                out = b.take(pa.array(take_from, pa.int64()))
                columns = [out.column(c) for c in range(4)] + [pa.array(windows, routed.field("windows").type), pa.array(leaves, pa.int32())]
                yield _batch(columns, routed)

    spread = queries.select("key", "id", "label", "v", "windows").mapInArrow(route, routed_ddl)
    spread = spread.join(F.broadcast(index.blocks), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    stream = index.rows.withColumn("asks", F.lit(0)).unionByName(spread.withColumn("asks", F.lit(1)), allowMissingColumns=True)
    columns = ["leaf", "block", "asks", "id", "label", "v", "key", "windows"]
    stream = stream.select(*columns).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "asks", "id")
    found_schema = to_arrow_schema(StructType.fromDDL(_FOUND))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, rows = None, []
        block: tuple | None = None
        for b in batches:
            place = np.column_stack([np.asarray(b.column(c)) for c in range(3)])
            cuts = np.flatnonzero(np.any(np.diff(place, axis=0) != 0, axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(place)]):
                if start == end:
                    continue
                leaf, no, asks = place[start]
                part = b.slice(start, end - start)
                if (leaf, no) != where:
                    where, rows, block = (leaf, no), [], None
                if not asks:
                    rows.append((np.asarray(part.column("id")), np.asarray(part.column("label")), _matrix(part.column("v"), width)))
                    continue
                if block is None:
                    if not rows:
                        continue
                    block = tuple(np.concatenate(c) for c in zip(*rows))
                for at in range(0, part.num_rows, p.queries_at_once):
                    yield from _answers(part.slice(at, p.queries_at_once), block)

    def _answers(asked: pa.RecordBatch, block: tuple) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = block
        s = scores(_matrix(asked.column("v"), width), vectors)
        out_key, out_no, out_id, out_score = [], [], [], []
        keys, own, label, windows = (asked.column(c).to_pylist() for c in ("key", "id", "label", "windows"))
        for i in range(len(s)):
            fits = np.flatnonzero((ids != own[i]) & ((labels == label[i]) == same_label))
            mine = s[i][fits]
            lowest = min((w["low"] for w in windows[i]), default=_HIGH)
            over = np.flatnonzero(mine >= lowest)
            # Rows are in the order of their ids, so a stable sort settles ties by id.
            order = over[np.argsort(-mine[over], kind="stable")]
            ranked = -mine[order]
            for w in windows[i]:
                first = np.searchsorted(ranked, -w["high"], "left")
                last = min(first + take, np.searchsorted(ranked, -w["low"], "right"))
                if last > first:
                    picked = order[first:last]
                    out_key += [keys[i]] * len(picked)
                    out_no += [w["no"]] * len(picked)
                    out_id += ids[fits[picked]].tolist()
                    out_score += mine[picked].tolist()
        if out_key:
            yield _batch([pa.array(c) for c in (out_key, out_no, out_id, out_score)], found_schema)

    found = stream.mapInArrow(answer, _FOUND)
    rank = F.row_number().over(Window.partitionBy("key", "no").orderBy(F.desc("score"), "found_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= take)


def mine_negatives(rows: DataFrame, anchor: Column, mining: Mining | None = None, params: HyperplaneTree | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that ``anchor`` picks.

    ``rows(id, label, v)`` as of ``usable_rows``; ``low`` is below ``high``, so a negative positive score has no window. A repeated row is a row of its own as positive or negative and one
    anchor. Rows that share an id are never each other's positives or negatives. Vectors of different lengths are
    filled up with zeros. An empty table, or no anchor, gives no rows. The result is exact.
    """
    m, p = mining or Mining(), params or HyperplaneTree()
    spark = rows.sparkSession
    index = build_index(rows, p)
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if index is None:
        return spark.createDataFrame([], result)
    anchors = index.rows.where(anchor).select("id", "label", "v").distinct().withColumn("key", F.monotonically_increasing_id())
    path = scratch_path(spark, "anchors")
    anchors.write.parquet(path)
    anchors = spark.read.parquet(path)
    window = "array<struct<no:int,low:long,high:long>>"
    everything = F.array(F.struct(F.lit(0).alias("no"), F.lit(_LOW).alias("low"), F.lit(_HIGH).alias("high"))).cast(window)
    positives = search(index, anchors.withColumn("windows", everything), m.positives, True, p)
    path = scratch_path(spark, "positives")
    positives.select("key", F.col("rank").alias("no"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")).write.parquet(path)
    positives = spark.read.parquet(path)
    # Whole hundreds and the rest apart, so that no product leaves 64 bits; below zero no score fits.
    low, high = (f"positive_score div 100 * {share} + (positive_score % 100 * {share} + {up}) div 100" for share, up in ((m.low, 99), (m.high, 0)))
    bounds = F.struct("no", F.expr(low).alias("low"), F.expr(high).alias("high"))
    windows = positives.where("positive_score >= 0").groupBy("key").agg(F.collect_list(bounds).cast(window).alias("windows"))
    negatives = search(index, anchors.join(windows, "key"), m.negatives, False, p)
    named = positives.join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    out = negatives.select("key", "no", "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(out, ["key", "no"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
