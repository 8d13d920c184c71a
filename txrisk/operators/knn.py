"""Exact k nearest neighbours under Euclidean distance.

Three ways, picked by measured sizes, all exact:

* few queries: they are broadcast, every partition of the rows keeps its own top k per query,
  and the partial tops are merged. Rows are never shuffled. With many rows a first pass over a
  hash sample bounds each query's k-th distance, so the main pass emits only closer pairs.
* many queries, short vectors: a tree of cuts, sampled and grown, deals the rows into cells of like size; a
  query is compared with its own cell and with those that its k-th distance there reaches into.
* many queries, long vectors: an approximation file holds every row as one byte per dimension and the distance to
  the vector those bytes stand for. A distance to that vector, give or take the row's own error, bounds
  the true one from both sides. Cells around pivot rows are ruled out by the triangle inequality where
  the data allow it; in the other ones the bytes of a block are compared with a block of queries, and
  only rows whose lower bound is within the k-th upper bound become candidates. Exact vectors are
  read for candidates alone, a little more than k per query.

Partial tops are little more than k rows per (query, block); no pair list is ever materialised. Ids may be of
any type that can be ordered: those that are not whole numbers are numbered first, in their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.vectors import squared_error
from txrisk.operators.ordering import group_rank, stored
from txrisk.session import max_broadcast_bytes

PAIR_SCHEMA = "query_id long, neighbor_id long, neighbor_tag int, distance double"
_PAIRS_PER_STEP = 400_000
BLOCK_ROWS = 20_000
SAMPLE_ABOVE = 1_000_000
_LEVELS = 256


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype="float64") if len(column) else np.zeros((0, 1))


def _keep_k(q: np.ndarray, r: np.ndarray, tag: np.ndarray, d: np.ndarray, k: int, per_tag: bool = False):
    """The k best (distance, then id) entries per query, or per query and tag."""
    of = tag if per_tag else np.zeros(len(tag), "int32")
    order = np.lexsort((r, d, of, q))
    q, r, tag, d, of = q[order], r[order], tag[order], d[order], of[order]
    starts = np.r_[True, (q[1:] != q[:-1]) | (of[1:] != of[:-1])] if len(q) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(starts, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    keep = np.arange(len(q)) - first < k
    return q[keep], r[keep], tag[keep], d[keep]


def _block_top(qid, Q, qgroup, bound, rid, R, rgroup, tag, k: int, per_tag: bool = False, key=None):
    """Top k rows of one block per query, or per query and tag. ``key`` stands for a query in the result, else its id.

    The matrix product ranks roughly; whatever is within rounding reach of the k-th value gets
    its distance from the differences.
    """
    out = []
    if not len(rid) or not len(qid):
        return (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "int32"), np.zeros(0))
    if per_tag:
        tops = [_block_top(qid, Q, qgroup, bound, rid[tag == t], R[tag == t], rgroup[tag == t], tag[tag == t], k) for t in np.unique(tag)]
        return tuple(np.concatenate(c) for c in zip(*tops))
    key = qid if key is None else key
    rr = (R * R).sum(1)
    step = max(1, _PAIRS_PER_STEP // len(rid))
    for s in range(0, len(qid), step):
        part = slice(s, s + step)
        qq = (Q[part] * Q[part]).sum(1)
        rough = qq[:, None] + rr[None, :] - 2.0 * (Q[part] @ R.T)
        rough[(qid[part][:, None] == rid[None, :]) | (qgroup[part][:, None] != rgroup[None, :])] = np.inf
        slack = 1e-9 * (qq.max() + rr.max() + 1.0)
        limit = (bound[part] ** 2) + slack
        if len(rid) > k:
            limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
        qi, ri = np.nonzero((rough <= limit[:, None]) & np.isfinite(rough))
        dist = np.empty(len(qi))
        for i in range(0, len(qi), 50_000):
            diff = Q[part][qi[i : i + 50_000]] - R[ri[i : i + 50_000]]
            dist[i : i + 50_000] = np.sqrt((diff * diff).sum(1))
        out.append(_keep_k(key[part][qi], rid[ri], tag[ri], dist, k))
    return tuple(np.concatenate(c) for c in zip(*out))


def _frame(parts) -> pd.DataFrame:
    q, r, tag, d = parts
    return pd.DataFrame({"query_id": q, "neighbor_id": r, "neighbor_tag": tag, "distance": d})


def _narrow(df: DataFrame, row_id: str, features: str, group: str | None, tag: str | None) -> DataFrame:
    return df.select(
        F.col(row_id).alias("id"),
        F.col(features).cast("array<double>").alias("x"),
        (F.col(group).cast("int") if group else F.lit(0)).alias("g"),
        (F.col(tag).cast("int") if tag else F.lit(0)).alias("t"),
    )


def _scan_top(queries: pd.DataFrame, bounds: np.ndarray, rows: DataFrame, k: int, per_tag: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(
        (queries["id"].to_numpy("int64"), _matrix(queries["x"]), queries["g"].to_numpy("int32"), bounds)
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, Q, qg, bound = shared.value
        best = None
        for b in batches:
            new = _block_top(
                qid, Q, qg, bound, b["id"].to_numpy("int64"), _matrix(b["x"]), b["g"].to_numpy("int32"), b["t"].to_numpy("int32"), k, per_tag
            )
            best = new if best is None else tuple(np.concatenate(c) for c in zip(best, new))
            if len(best[0]) > 8 * k * max(1, len(qid)):
                best = _keep_k(*best, k, per_tag)
        if best is not None:
            yield _frame(_keep_k(*best, k, per_tag))

    return rows.mapInPandas(scan, PAIR_SCHEMA)


def _merge(pairs: DataFrame, k: int, per_tag: bool) -> DataFrame:
    best = Window.partitionBy("query_id", *(["neighbor_tag"] if per_tag else [])).orderBy("distance", "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _by_broadcast(queries: DataFrame, rows: DataFrame, k: int, many_rows: bool, per_tag: bool) -> DataFrame:
    local = queries.toPandas()  # size checked by the caller
    bounds = np.full(len(local), np.inf)
    if many_rows and not per_tag:
        sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(100)) == 0)
        tops = _merge(_scan_top(local, bounds, sample, k, False), k, False).filter(F.col("rank") == k).select("query_id", "distance")
        known = {r["query_id"]: r["distance"] for r in tops.collect()}
        bounds = np.array([known.get(i, np.inf) for i in local["id"]])
    return _merge(_scan_top(local, bounds, rows, k, per_tag), k, per_tag)


# ---- approximation file ----------------------------------------------------------------


def encode(x: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one byte per dimension, distance between a row and what its bytes stand for)."""
    code = np.clip(np.floor((x - low) / width), 0, _LEVELS - 1).astype("uint8")
    off = x - decode(code, low, width)
    return code, np.sqrt((off * off).sum(1))


def decode(code: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    return low + (code.astype("float64") + 0.5) * width


def bounds_of(Q: np.ndarray, R: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances, from decoded rows and their errors."""
    qq, rr = (Q * Q).sum(1), (R * R).sum(1)
    square = qq[:, None] + rr[None, :] - 2.0 * (Q @ R.T)
    slack = 1e-9 * (qq.max(initial=0.0) + rr.max(initial=0.0) + 1.0)
    near, far = np.sqrt(np.maximum(square - slack, 0.0)), np.sqrt(np.maximum(square + slack, 0.0))
    return near - error[None, :] * (1 + 1e-9), far + error[None, :] * (1 + 1e-9)


_CODED = "key long, id long, g int, t int, code binary, error double, cell int, to_pivot double"
_CANDIDATE = "query_key long, key long, t int, least double, most double"


def _coded(df: DataFrame, pivots: np.ndarray, low: np.ndarray, width: np.ndarray) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((pivots, low, width))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        P, lo, w = shared.value
        for b in batches:
            if not len(b):
                continue
            X = _matrix(b["x"])
            cell, dist = np.empty(len(X), "int32"), np.empty(len(X))
            for s in range(0, len(X), 1000):
                d = np.sqrt(((X[s : s + 1000, None, :] - P[None, :, :]) ** 2).sum(2))
                cell[s : s + 1000] = d.argmin(1)
                dist[s : s + 1000] = d.min(1)
            code, error = encode(X, lo, w)
            yield b[["key", "id", "g", "t"]].assign(code=[c.tobytes() for c in code], error=error, cell=cell, to_pivot=dist)

    return df.mapInPandas(assign, _CODED)


def _candidates(qkey, qid, Q, qgroup, bound, rkey, rid, R, rgroup, tag, error, k: int) -> pd.DataFrame:
    """Rows of a block that may be among a query's k nearest by the bounds, always those of the k least upper ones."""
    out = []
    step = max(1, _PAIRS_PER_STEP // max(1, len(rkey)))
    for s in range(0, len(qkey) if len(rkey) else 0, step):
        part = slice(s, s + step)
        least, most = bounds_of(Q[part], R, error)
        not_me = (qid[part][:, None] != rid[None, :]) & (qgroup[part][:, None] == rgroup[None, :])
        most = np.where(not_me, most, np.inf)
        limit = bound[part]
        if len(rkey) > k:
            limit = np.minimum(limit, np.partition(most, k - 1, axis=1)[:, k - 1])
        qi, ri = np.nonzero(not_me & (least <= limit[:, None]))
        out.append(pd.DataFrame({"query_key": qkey[part][qi], "key": rkey[ri], "t": tag[ri], "least": least[qi, ri], "most": most[qi, ri]}))
    if not out:
        return pd.DataFrame({"query_key": [], "key": [], "t": [], "least": [], "most": []}).astype({"query_key": "int64", "key": "int64", "t": "int32"})
    return pd.concat(out)


def _search_blocks(routed: DataFrame, blocked: DataFrame, low: np.ndarray, width: np.ndarray, k: int, per_tag: bool) -> DataFrame:
    """Candidates per query and block; both sides carry (cell, block, qblock)."""

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        codes = np.frombuffer(b"".join(r["code"]), dtype="uint8").reshape(len(r), len(low)) if len(r) else np.zeros((0, len(low)), "uint8")
        tag = r["t"].to_numpy("int32")
        sides = [tag == t for t in np.unique(tag)] if per_tag else [np.ones(len(r), bool)]
        mine = [q["key"].to_numpy("int64"), q["id"].to_numpy("int64"), _matrix(q["x"]), q["g"].to_numpy("int32"), q["bound"].to_numpy("float64")]
        rows = [r["key"].to_numpy("int64"), r["id"].to_numpy("int64"), decode(codes, low, width), r["g"].to_numpy("int32"), tag, r["error"].to_numpy("float64")]
        parts = [_candidates(*mine, *[c[side] for c in rows], k) for side in sides]
        return pd.concat(parts) if parts else _candidates(*mine, *rows, k)

    on = ["cell", "block", "qblock"]
    return routed.groupBy(*on).cogroup(blocked.groupBy(*on)).applyInPandas(search, _CANDIDATE)


def _kth_upper(candidates: DataFrame, k: int, per_tag: bool) -> DataFrame:
    """Per query (and tag) the k-th least upper bound, none with fewer candidates."""
    of = ["query_key", *(["t"] if per_tag else [])]
    ranked = candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*of).orderBy("most", "key")))
    return ranked.filter(F.col("_r") == k).select(*of, F.col("most").alias("_limit"))


def _by_codes(queries: DataFrame, rows: DataFrame, k: int, n_rows: int, block_rows: int, per_tag: bool) -> DataFrame:
    rows, _ = stored(rows.withColumn("key", F.monotonically_increasing_id()))
    queries, _ = stored(queries.withColumn("key", F.monotonically_increasing_id()))
    n_pivots = int(min(256, max(2, math.isqrt(n_rows))))
    picked = rows.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(n_pivots).toPandas()
    pivots = np.unique(_matrix(picked["x"]), axis=0)
    span = rows.select(Summarizer.metrics("min", "max").summary(array_to_vector("x")).alias("s")).first()["s"]
    low = span["min"].toArray()
    width = (span["max"].toArray() - low) / _LEVELS
    width = np.where(width > 0, width, 1.0)
    file, _ = stored(_coded(rows, pivots, low, width))
    stats = file.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("to_pivot").alias("radius")).collect()
    radius, blocks = np.full(len(pivots), -np.inf), np.zeros(len(pivots), "int64")
    for s in stats:
        radius[s["cell"]], blocks[s["cell"]] = s["radius"], math.ceil(s["n"] / block_rows)
    n_blocks = F.element_at(F.lit([int(b) for b in blocks]), F.col("cell") + 1)
    file = file.withColumn("block", F.pmod(F.xxhash64("key"), F.greatest(n_blocks, F.lit(1))).cast("int"))
    homes = _coded(queries, pivots, low, width).select("key", "cell").join(queries, "key")

    def with_query_blocks(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Cut the queries of a (cell, block) into bounded pieces and give each piece the block's rows."""
        sizes = routed.groupBy("cell").count().collect()
        pieces = np.ones(len(pivots), "int64")
        for s in sizes:
            per_block = s["count"] / max(1, blocks[s["cell"]])
            pieces[s["cell"]] = max(1, math.ceil(per_block / block_rows))
        count = F.element_at(F.lit([int(p) for p in pieces]), F.col("cell") + 1)
        split = routed.withColumn("qblock", F.pmod(F.xxhash64(F.col("key"), F.lit(7)), count).cast("int"))
        copies = file.withColumn("qblock", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
        return split, copies

    own = homes.filter(F.element_at(F.lit([int(b) for b in blocks]), F.col("cell") + 1) > 0).withColumns(
        {"block": F.pmod(F.xxhash64("key"), n_blocks).cast("int"), "bound": F.lit(float("inf"))}
    )
    first = _kth_upper(_search_blocks(*with_query_blocks(own), low, width, k, per_tag), k, per_tag)
    if per_tag:
        # A cell is of no use only if it is so for every tag.
        tags = rows.select("t").distinct().count()
        first = first.groupBy("query_key").agg(F.max("_limit").alias("_limit"), F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= tags)
    first = first.select(F.col("query_key").alias("key"), F.col("_limit").alias("bound"))
    bounded, _ = stored(queries.join(first, "key", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))))

    shared = rows.sparkSession.sparkContext.broadcast((pivots, radius, blocks))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        P, reach, count = shared.value
        for b in batches:
            if not len(b):
                continue
            X, limit = _matrix(b["x"]), b["bound"].to_numpy("float64")
            cells = []
            for i in range(len(X)):
                to_pivots = np.sqrt(((X[i] - P) ** 2).sum(1))
                nearest = to_pivots - reach
                cells.append(np.nonzero((count > 0) & (nearest <= limit[i] * (1 + 1e-9) + 1e-9))[0].astype("int32"))
            yield b[["key", "id", "x", "g", "bound"]].assign(cells=cells)

    routed = bounded.select("key", "id", "x", "g", "bound").mapInPandas(
        route, "key long, id long, x array<double>, g int, bound double, cells array<int>"
    )
    spread = routed.select("key", "id", "x", "g", "bound", F.explode("cells").alias("cell")).select(
        "*", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))).alias("block")
    )
    found, _ = stored(_search_blocks(*with_query_blocks(spread), low, width, k, per_tag))
    of = ["query_key", *(["t"] if per_tag else [])]
    limits = _kth_upper(found, k, per_tag)
    kept = found.join(limits, of, "left").filter(F.col("least") <= F.coalesce("_limit", F.lit(float("inf"))))
    # The exact vectors, for candidates alone.
    ends = rows.select("key", F.col("id").alias("neighbor_id"), F.col("t").alias("neighbor_tag"), F.col("x").alias("_y"))
    starts = queries.select(F.col("key").alias("query_key"), F.col("id").alias("query_id"), F.col("x").alias("_x"))
    exact = kept.select("query_key", "key").join(ends, "key").join(starts, "query_key")
    pairs = exact.select("query_id", "neighbor_id", "neighbor_tag", F.sqrt(squared_error(F.col("_x"), F.col("_y"))).alias("distance"), "query_key")
    best = Window.partitionBy("query_key", *(["neighbor_tag"] if per_tag else [])).orderBy("distance", "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("query_key")


# ---- cells ------------------------------------------------------------------------------

#: Vectors up to this long are searched whole in cells of a tree; of longer ones blocks hold one byte per dimension.
NARROW = 16
LEAF_ROWS = 1024
#: More comparisons than this and short vectors go into cells, though the queries could be broadcast.
SCANNED_PAIRS = 200_000_000
_MOST_LEAVES = 8192
_SAMPLED_PER_LEAF = 16


@dataclass(frozen=True)
class Forest:
    """A tree of cuts per group: node -> (axis, cut, node below, node above); a negative node is leaf ``~node``.

    ``roots`` has the node a group begins with. Groups that are not in it are one cell each.
    """

    roots: dict[tuple[int, int], int]
    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    leaves: int

    def by_group(self, g: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for group in set(zip(g.tolist(), t.tolist())):
            if group in self.roots:
                yield self.roots[group], np.flatnonzero((g == group[0]) & (t == group[1]))

    def leaf_of(self, g: np.ndarray, t: np.ndarray, X: np.ndarray) -> np.ndarray:
        """The leaf of every row, -1 in a group without a tree."""
        leaf = np.full(len(X), -1, "int32")
        for root, of in self.by_group(g, t):
            node = np.full(len(of), root)
            while (inner := np.flatnonzero(node >= 0)).size:
                n = node[inner]
                node[inner] = np.where(X[of[inner], self.axis[n]] <= self.cut[n], self.low[n], self.high[n])
            leaf[of] = ~node
        return leaf

    def leaves_near(self, g: np.ndarray, t: np.ndarray, X: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) for all leaves whose side of the cuts is within ``reach`` of the query."""
        found = [(np.zeros(0, int), np.zeros(0, int))]
        for root, of in self.by_group(g, t):
            query, node = of, np.full(len(of), root)
            while len(query):
                done = node < 0
                found.append((query[done], ~node[done]))
                query, node = query[~done], node[~done]
                off = X[query, self.axis[node]] - self.cut[node]
                below, above = off <= reach[query], -off <= reach[query]
                query = np.concatenate([query[below], query[above]])
                node = np.concatenate([self.low[node[below]], self.high[node[above]]])
        return tuple(np.concatenate(c) for c in zip(*found))


def grow(g: np.ndarray, t: np.ndarray, X: np.ndarray, per_leaf: int) -> Forest:
    """Cut the sampled rows of every group along their widest axis, near the median, down to ``per_leaf`` rows."""
    nodes: list[list] = []
    roots, leaves = {}, 0
    for group in set(zip(g.tolist(), t.tolist())):
        # (rows, where to write the node's number: parent and side)
        open_parts: list = [(np.flatnonzero((g == group[0]) & (t == group[1])), None, 0)]
        while open_parts:
            of, parent, side = open_parts.pop()
            spread = np.ptp(X[of], axis=0) if len(of) > per_leaf else np.zeros(1)
            if spread.max(initial=0.0) > 0:
                a = int(spread.argmax())
                values = np.sort(X[of, a])
                at = values[(len(values) - 1) // 2]
                at = at if at < values[-1] else values[values < at][-1]
                number = len(nodes)
                nodes.append([a, at, 0, 0])
                below = X[of, a] <= at
                open_parts += [(of[below], number, 2), (of[~below], number, 3)]
            else:
                number, leaves = ~leaves, leaves + 1
            if parent is None:
                roots[group] = number
            else:
                nodes[parent][side] = number
    axis, cut, low, high = (np.array(c) for c in zip(*nodes)) if nodes else (np.zeros(0, int),) * 4
    return Forest(roots, axis, cut, low, high, leaves)


_PLACED = "key long, id long, x binary, g int, t int, c int, leaf int, m long"
_ROUTED = "key long, id long, x binary, g int, c int, leaf int, bound double"
_DEALT_TO = ["g", "c", "leaf", "block", "qblock"]
_FOUND = "query_key long, query_id long, neighbor_id long, neighbor_tag int, c int, distance double, m long"


def _wide(column: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="float64").reshape(len(column), dims)


def _by_cells(queries: DataFrame, rows: DataFrame, k: int, dims: int, block_rows: int, per_tag: bool) -> DataFrame:
    """Cells of about as many rows each, however dense the rows lie, from the cuts of a sampled tree.

    Of rows with the same vector only those of the k + 1 least ids can be among a query's nearest, so no others are
    searched. A query is compared with all rows of its own cell; the k-th distance there bounds the rest: only cells
    whose box is that near are searched too. A block gives k rows per query and nothing else leaves it.
    """
    spark = rows.sparkSession
    c = F.col("t") if per_tag else F.lit(0)
    finite = F.forall("x", lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    # Ids that repeat with their vector are one row with a count.
    same = rows.filter(finite).groupBy("x", "g", "t", "id").agg(F.count(F.lit(1)).alias("m")).withColumn("c", c)
    first = F.dense_rank().over(Window.partitionBy("x", "g", "c").orderBy("id"))
    distinct, n = stored(same.withColumn("_r", first).filter(F.col("_r") <= k + 1).select("id", "x", "g", "t", "c", "m"))
    asked = queries.filter(finite).withColumn("key", F.monotonically_increasing_id()).select("key", "id", "x", "g")
    if per_tag:
        asked = asked.crossJoin(F.broadcast(distinct.select("c").distinct()))
    else:
        asked = asked.withColumn("c", F.lit(0))
    leaf_rows = min(LEAF_ROWS, block_rows)
    leaves = min(_MOST_LEAVES, max(1, math.ceil(n / leaf_rows)))
    share = min(1.0, leaves * _SAMPLED_PER_LEAF / max(n, 1))
    sample = distinct.filter(F.pmod(F.xxhash64("x", "id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("g", "c", "x").toPandas()
    forest = grow(sample["g"].to_numpy("int64"), sample["c"].to_numpy("int64"), _matrix(sample["x"]), max(1, math.ceil(share * n / leaves)))
    shared = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                X = _matrix(b["x"])
                leaf = shared.value.leaf_of(b["g"].to_numpy("int64"), b["c"].to_numpy("int64"), X)
                yield b.assign(x=[v.tobytes() for v in X], leaf=leaf)[[f.split()[0] for f in _PLACED.split(", ")]]

    file, _ = stored(distinct.withColumn("key", F.lit(0)).mapInPandas(place, _PLACED))
    homes, _ = stored(asked.withColumns({"t": F.lit(0), "m": F.lit(1)}).mapInPandas(place, _PLACED))

    unpack = F.udf(lambda x: np.frombuffer(x, "float64").tolist(), "array<double>")
    flat = file.filter("leaf >= 0").withColumn("v", unpack("x"))
    edges = [f(F.get("v", F.lit(i))).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(dims)]
    blocks, low, high = np.ones(forest.leaves + 1, "int64"), np.full((forest.leaves, dims), np.inf), np.full((forest.leaves, dims), -np.inf)
    for s in flat.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *edges).collect():
        blocks[s["leaf"]] = math.ceil(s["n"] / block_rows)
        low[s["leaf"]], high[s["leaf"]] = [s[f"low{i}"] for i in range(dims)], [s[f"high{i}"] for i in range(dims)]
    boxes = spark.sparkContext.broadcast((low, high))

    def searched(routed: DataFrame) -> DataFrame:
        """The k nearest of every query in each block of the leaf it is routed to."""
        pieces = np.ones(forest.leaves + 1, "int64")
        for s in routed.filter("leaf >= 0").groupBy("leaf").count().collect():
            pieces[s["leaf"]] = math.ceil(s["count"] / block_rows)
        cut = spark.sparkContext.broadcast((blocks, pieces))

        def dealt(side: str):
            def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                n_blocks, n_pieces = cut.value
                mine, other, name, copied = (n_blocks, n_pieces, "block", "qblock") if side == "row" else (n_pieces, n_blocks, "qblock", "block")
                for b in batches:
                    leaf, h = b["leaf"].to_numpy(), b.pop("h").to_numpy("int64")
                    times = other[leaf]
                    at = np.repeat(np.arange(len(b)), times)
                    number = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    yield b.iloc[at].assign(**{name: (h % mine[leaf])[at].astype("int32"), copied: number.astype("int32")})

            return deal

        hashed = F.pmod(F.xxhash64("key", "id", "x"), F.lit(1 << 30)).alias("h")
        left = routed.select("*", hashed).mapInPandas(dealt("query"), _ROUTED + ", qblock int, block int")
        right = file.select("id", "x", "g", "t", "c", "leaf", "m", hashed).mapInPandas(
            dealt("row"), "id long, x binary, g int, t int, c int, leaf int, m long, block int, qblock int"
        )

        def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(r):
                return pd.DataFrame({f.split()[0]: [] for f in _FOUND.split(", ")})
            number, no_group = np.arange(len(q)), np.zeros(1, "int32")
            at, neighbor, row, distance = _block_top(
                q["id"].to_numpy("int64"), _wide(q["x"], dims), np.zeros(len(q), "int32"), q["bound"].to_numpy("float64"),
                r["id"].to_numpy("int64"), _wide(r["x"], dims), np.broadcast_to(no_group, len(r)), np.arange(len(r), dtype="int32"), k, key=number,
            )
            return pd.DataFrame(
                {
                    "query_key": q["key"].to_numpy()[at], "query_id": q["id"].to_numpy()[at], "neighbor_id": neighbor,
                    "neighbor_tag": r["t"].to_numpy()[row], "c": q["c"].to_numpy()[at], "distance": distance, "m": r["m"].to_numpy()[row],
                }
            )

        return left.groupBy(*_DEALT_TO).cogroup(right.groupBy(*_DEALT_TO)).applyInPandas(search, _FOUND)

    def ranked(pairs: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_key", "c").orderBy("distance", "neighbor_id")
        return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    open_ends = homes.withColumn("bound", F.lit(float("inf")))
    near, _ = stored(ranked(searched(open_ends.select("key", "id", "x", "g", "c", "leaf", "bound"))))
    limits = near.filter(F.col("rank") == k).select(F.col("query_key").alias("key"), "c", F.col("distance").alias("bound"))
    bounded = homes.filter("leaf >= 0").join(limits, ["key", "c"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            X, bound = _wide(b["x"], dims), b["bound"].to_numpy("float64")
            reach = bound * (1 + 1e-9) + 1e-9
            at, leaf = shared.value.leaves_near(b["g"].to_numpy("int64"), b["c"].to_numpy("int64"), X, reach)
            other = leaf != b["leaf"].to_numpy()[at]
            at, leaf = at[other], leaf[other]
            box_low, box_high = boxes.value
            keep = np.zeros(len(at), bool)
            for s in range(0, len(at), 100_000):
                a, on = at[s : s + 100_000], leaf[s : s + 100_000]
                off = np.maximum(np.maximum(box_low[on] - X[a], X[a] - box_high[on]), 0.0)
                keep[s : s + 100_000] = np.sqrt((off * off).sum(1)) <= reach[a]
            at, leaf = at[keep], leaf[keep]
            yield b.iloc[at].assign(leaf=leaf.astype("int32"))

    routed, _ = stored(bounded.select("key", "id", "x", "g", "c", "leaf", "bound").mapInPandas(route, _ROUTED))
    pairs = near.drop("rank").unionByName(searched(routed))
    counted = ranked(pairs).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("m", F.lit(k)).cast("int"))))
    out = ranked(counted.drop("rank", "_copy")).select("query_id", "neighbor_id", "neighbor_tag", "distance", "rank")
    return stored(out)[0]


def _numbered(q: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables with ids numbered in their order, and the numbers."""
    ids, _ = stored(q.select("id").unionByName(r.select("id")).filter(F.col("id").isNotNull()).distinct())
    numbers, _ = stored(group_rank(ids, [], ["id"], "_no"))
    return *[t.join(numbers, "id").withColumn("id", F.col("_no").cast("long")).drop("_no") for t in (q, r)], numbers


def knn_topk(
    queries: DataFrame,
    rows: DataFrame,
    k: int,
    row_id: str = "id",
    features: str = "features",
    group: str | None = None,
    tag: str | None = None,
    block_rows: int = BLOCK_ROWS,
    per_tag: bool = False,
) -> DataFrame:
    """(query_id, neighbor_id, neighbor_tag, distance, rank): the k nearest rows, the query itself excluded.

    Ties go to the smaller id; rows without an id are left out. ``group`` restricts neighbours to the query's own
    group, ``tag`` is an integer column of the neighbour to carry along; ``per_tag`` finds the k nearest of every tag.
    """
    q, r = _narrow(queries, row_id, features, group, None), _narrow(rows, row_id, features, group, tag)
    kind = r.schema["id"].dataType
    numbers = None
    if not isinstance(kind, T.IntegralType):
        q, r, numbers = _numbered(q, r)
    q, r = (t.filter(F.col("id").isNotNull()).withColumn("id", F.col("id").cast("long")) for t in (q, r))
    size = q.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("d")).first()
    n_rows = r.count()
    narrow = 0 < size["d"] <= NARROW
    few = size["n"] * (size["d"] * 8 + 64) <= max_broadcast_bytes(queries.sparkSession) and not (narrow and size["n"] * n_rows > SCANNED_PAIRS)
    if few or not n_rows:
        pairs = _by_broadcast(q, r, k, n_rows > SAMPLE_ABOVE, per_tag)
    elif narrow:
        pairs = _by_cells(q, r, k, size["d"], block_rows, per_tag)
    else:
        pairs = _by_codes(q, r, k, n_rows, block_rows, per_tag)
    if numbers is None:
        return pairs.withColumns({c: F.col(c).cast(kind) for c in ("query_id", "neighbor_id")})
    for c in ("query_id", "neighbor_id"):
        pairs = pairs.join(numbers.select(F.col("_no").alias(c), F.col("id").alias("_id")), c).withColumn(c, F.col("_id")).drop("_id")
    return pairs


def overall(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of all tags from the k nearest (or more) of each."""
    best = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
