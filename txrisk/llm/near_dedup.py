"""Near-duplicate documents by min-max hashing.

Each of ``permutations`` hash functions is evaluated once per shingle and gives two signature values,
the smallest and the largest hash. Both agree between two sets with probability equal to their Jaccard
similarity, so a signature of 2 * permutations values costs half the hash evaluations. Bands of ``rows``
values propose links; every proposed link is confirmed on the full sets.

No bucket is expanded into all its pairs. Documents with equal sets are one node. Within a bucket every
node is compared with the bucket's hub only; after that, for some rounds, one representative per component is compared
with another hub. What is left are buckets that hold nodes of different components: their nodes are cut into blocks,
every set travels once per opposing block, and a task compares two blocks and gives a spanning forest of the
confirmed links, so no link between components is lost and no pair is written down.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from txrisk.llm.batches import small_batches
from txrisk.llm.columns import fresh
from txrisk.llm.components import connected_components, settled
from txrisk.llm.text_hash import lower_ascii, mix, shingle_set
from txrisk.session import ensure_checkpoint_dir, max_broadcast_bytes


@dataclass(frozen=True)
class NearDedup:
    """Parameters. The chance to miss a link at the threshold is (1 - threshold**rows)**bands."""

    shingle_words: int = 5
    percent: int = 80
    permutations: int = 100
    rows: int = 5
    hub_rounds: int = 3

    @property
    def bands(self) -> int:
        return 2 * self.permutations // self.rows


def band_keys(shingles: np.ndarray, p: NearDedup) -> np.ndarray:
    """One 64-bit key per band from the min-max signature of a non-empty shingle set."""
    factors = np.random.default_rng(20).integers(1, 1 << 63, p.permutations, dtype=np.uint64) | np.uint64(1)
    low = np.full(p.permutations, np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(p.permutations, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        hashes = shingles[at : at + 4096, None] * factors
        np.minimum(low, hashes.min(axis=0), out=low)
        np.maximum(high, hashes.max(axis=0), out=high)
    signature = np.concatenate([low, high])
    # A band takes its values from all over the signature, so it rarely has both ends of one permutation.
    order = np.random.default_rng(21).permutation(len(signature))[: p.bands * p.rows]
    keys = np.arange(p.bands, dtype=np.uint64)
    for column in signature[order].reshape(p.rows, p.bands):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _position() -> tuple[Column, ...]:
    """What orders the rows of a group: doc_id, null last, then the text's hash."""
    return F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("text_hash")


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _signed(documents: DataFrame, p: NearDedup) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set; null when empty), keys (one per band)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for text in batch["text"]:
                s = shingle_set(lower_ascii(text), p.shingle_words)
                sizes.append(len(s))
                nodes.append(_digest(s) if len(s) else None)
                keys.append(band_keys(s, p) if len(s) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_shingles": sizes, "node": nodes, "keys": keys, "text_hash": batch["text_hash"]})

    return documents.select(F.col("doc_id").cast("long"), "text", _text_hash().alias("text_hash")).mapInPandas(
        run, "doc_id long, n_shingles long, node binary, keys array<long>, text_hash long"
    )


def _sets(texts: DataFrame, p: NearDedup) -> DataFrame:
    """The full set of each wanted node; a text whose set is another one (a clash of text hashes) is passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, sets = [], []
            for node, text in zip(batch["node"], batch["text"]):
                s = shingle_set(lower_ascii(text), p.shingle_words)
                if len(s) and _digest(s) == bytes(node):
                    nodes.append(bytes(node))
                    sets.append(s.view(np.int64))
            yield pd.DataFrame({"node": nodes, "shingles": sets})

    return texts.select("node", "text").mapInPandas(run, "node binary, shingles array<long>")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, shared, total (size of the union) from the full sets of ``pairs(u, v)``, a checkpointed table."""
    if pairs.count() * 96 <= max_broadcast_bytes(pairs.sparkSession):
        ends = pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "node")
        sets = sets.join(F.broadcast(ends), "node", "left_semi")  # else all the sets take part in the shuffle
    shared = F.size(F.array_intersect("a", "b"))
    return (
        pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
        .join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
        .select("u", "v", shared.alias("shared"), (F.size("a") + F.size("b")).alias("both"))
        .select("u", "v", "shared", (F.col("both") - F.col("shared")).alias("total"))
    )


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(F.col("shared") * 100 >= F.col("total") * percent).select("u", "v")


def _hub_pairs(members: DataFrame, seed: int) -> DataFrame:
    """key, node, hub: one representative of each component in a bucket, with the one that comes first."""
    rank = F.struct(F.xxhash64(F.lit(seed), "node").alias("r"), "node", "n_shingles")
    heads = members.groupBy("key", "component").agg(F.min(rank).alias("head"))
    hubs = heads.groupBy("key").agg(F.min("head").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    return heads.join(hubs, "key").select(
        "key", F.col("head.node").alias("node"), F.col("hub.node").alias("hub"),
        F.col("head.n_shingles").alias("n_node"), F.col("hub.n_shingles").alias("n_hub"),
    )


def _ordered(hubbed: DataFrame) -> DataFrame:
    return hubbed.where("node != hub").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()


def _open_members(live: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of the buckets that hold nodes of several components."""
    labelled = live.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = labelled.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"))
    return labelled.join(ends.where("a != b").select("key"), "key")


#: Nodes and shingles a block of an open bucket holds, about.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 2_000_000
#: Up to so many nodes sets are intersected two by two, more by way of their shared shingles.
_FEW = 12
_PLACED = "key, low, high, block, node, component, shingles"
_LINK = "u binary, v binary"


def _blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of open buckets with their sets, once per opposing block of their bucket.

    A bucket of any size is cut into blocks; (low, high) names a pair of blocks, or a block with itself.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    count = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int")
    cut = members.join(sizes.select("key", count.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = spread.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component")
    return placed.join(sets, "node").select(*_PLACED.split(", "))


def _units(members: DataFrame) -> DataFrame:
    """The members of open buckets, with a bucket's key or, where that ships fewer sets, one key per family.

    Nodes that open buckets connect are a family. Near copies share many buckets; as one unit, a family's sets travel once
    per opposing block of the family, not once per bucket. Families that chance links have made large stay buckets.
    """

    def copies(n: Column, w: Column) -> Column:
        return n * F.greatest(F.ceil(n / BLOCK_NODES), F.ceil(w / BLOCK_SHINGLES))

    first = members.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    first = settled(first)
    stars = members.select("key", F.col("node").alias("u")).join(first.select("key", "v"), "key").select("u", "v")
    families = settled(connected_components(stars).withColumnRenamed("component", "family"))
    nodes = settled(members.select("node", "component", "n_shingles").distinct().join(families, "node"))
    as_one = nodes.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w")).select("family", copies(F.col("n"), F.col("w")).alias("one"))
    by_bucket = first.join(families, first["v"] == families["node"]).groupBy("family").agg(F.sum(copies(F.col("n"), F.col("w"))).alias("many"))
    better = settled(as_one.join(by_bucket, "family").where("one <= many").select("family"))
    whole = nodes.join(better, "family").select(F.xxhash64("family").alias("key"), "node", "component", "n_shingles")
    rest = members.join(nodes.join(better, "family", "left_anti").select("node"), "node").select("key", "node", "component", "n_shingles")
    return whole.union(rest)


class _Forest:
    """Components joined so far by the links of one pair of blocks."""

    def __init__(self) -> None:
        self.above: dict = {}

    def root(self, c):
        while c in self.above:
            c = self.above[c]
        return c

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[a] = b
        return a != b


def _forest_links(low: int, high: int, block: np.ndarray, nodes: list, components: list, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Confirmed links between two blocks (or inside one) that join components; not more than there are nodes."""
    forest, out = _Forest(), []
    sizes = np.array([len(s) for s in sets])
    left = np.flatnonzero(block == low)
    right = left if low == high else np.flatnonzero(block == high)

    def try_link(i: int, j: int, shared: int) -> None:
        if shared * 100 >= percent * (sizes[i] + sizes[j] - shared) and forest.join(components[i], components[j]):
            out.append((nodes[i], nodes[j]))

    def fits(i: int, j: np.ndarray) -> np.ndarray:
        return np.minimum(sizes[i], sizes[j]) * 100 >= np.maximum(sizes[i], sizes[j]) * percent

    if len(left) * len(right) <= _FEW * _FEW:
        for i in left:
            for j in right:
                if (low != high or i < j) and fits(i, j) and forest.root(components[i]) != forest.root(components[j]):
                    try_link(i, j, len(np.intersect1d(sets[i], sets[j], assume_unique=True)))
        return out
    # Postings of the right block: for every shingle the nodes that have it.
    owner = np.repeat(np.arange(len(right)), sizes[right])
    every = np.concatenate([sets[j] for j in right])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    for at, i in enumerate(left):
        start, end = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
        lengths = end - start
        if not lengths.sum():
            continue
        place = np.repeat(start - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner[place], minlength=len(right))
        close = (shared * 100 >= percent * (sizes[i] + sizes[right] - shared)) & fits(i, right)
        if low == high:
            close[: at + 1] = False
        for j in np.flatnonzero(close):
            try_link(i, right[j], int(shared[j]))
    return out


def _block_links(placed: DataFrame, percent: int) -> DataFrame:
    """u, v: links of ``_blocks``, a spanning forest per pair of blocks; the rows of a pair are one sorted stream."""
    schema = to_arrow_schema(StructType.fromDDL(_LINK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held = None, ([], [], [], [])

        def done() -> list[tuple]:
            if where is None or len(held[0]) < 2:
                return []
            return _forest_links(where[1], where[2], np.array(held[0]), held[1], held[2], held[3], percent)

        for b in batches:
            place = list(zip(*(b.column(c).to_pylist() for c in range(3))))
            block, node, component = (b.column(c).to_pylist() for c in range(3, 6))
            lists = b.column(6)
            ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            out = []
            for i, at in enumerate(place):
                if at != where:
                    out += done()
                    where, held = at, ([], [], [], [])
                # Copied, so that the batch is not kept alive.
                for part, value in zip(held, (block[i], node[i], component[i], np.sort(flat[ends[i] : ends[i + 1]]))):
                    part.append(value)
            if out:
                yield _links_batch(out, schema)
        last = done()
        if last:
            yield _links_batch(last, schema)

    ordered = placed.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return ordered.mapInArrow(run, _LINK)


def _links_batch(links: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in zip(*links)], schema=schema)


def near_components(documents: DataFrame, params: NearDedup | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash for every row of ``documents(doc_id, text, ...)``.

    ``component_id`` is the smallest doc_id that confirmed links reach, itself included; ``kept`` says
    that a row is the component's first by doc_id (null last) and then text hash. Texts without words (null, empty,
    white space) have no shingles, are linked with nothing and are kept; texts shorter than a shingle are one
    shingle. Rows with a null doc_id take part but never name a component that has another id. Repeated rows are
    one node; all repeats of the component's first row count as kept. ``text_hash`` tells texts under one doc_id
    apart. Other columns are ignored. Sets are compared by 64-bit shingle hashes.
    """
    p = params or NearDedup()
    ensure_checkpoint_dir(documents.sparkSession)
    small_batches(documents.sparkSession)
    signed = _signed(documents, p).checkpoint()

    nodes = signed.where("node is not null").groupBy("node").agg(F.first("keys").alias("keys"), F.first("n_shingles").alias("n_shingles"))
    banded = nodes.select("node", "n_shingles", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    live = banded.join(shared, "key").checkpoint()

    # Each set is read from one text: the row that comes first, and of its repeats only one.
    rows = signed.where("node is not null").groupBy("node", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = rows.groupBy("node").agg(F.min(F.struct(*_position(), "n")).alias("first")).select("node", "first.doc_id", "first.text_hash", "first.n")
    wanted = live.select("node").distinct().join(first, "node").checkpoint()
    texts = documents.select(F.col("doc_id").cast("long"), "text", _text_hash().alias("text_hash")).alias("d").join(
        wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash"))
    ).select("node", "text", "n")
    if not wanted.where("n > 1").isEmpty():
        texts = texts.where("n = 1").union(texts.where("n > 1").dropDuplicates(["node"]))
    sets = _sets(texts, p).checkpoint()

    # The first hubs meet every node of their buckets.
    hubbed = _hub_pairs(live.withColumn("component", F.col("node")), 0)
    hubbed = hubbed.where(_sizes_fit(F.col("n_node"), F.col("n_hub"), p.percent))
    components = connected_components(_linked(_compared(settled(_ordered(hubbed)), sets), p.percent))
    # More hubs, now among components.
    for seed in range(1, p.hub_rounds):
        heads = _hub_pairs(_open_members(live, components), seed)
        heads = heads.where(_sizes_fit(F.col("n_node"), F.col("n_hub"), p.percent))
        links = _linked(_compared(settled(_ordered(heads)), sets), p.percent)
        components = connected_components(components.toDF("u", "v").union(links))
    # Whatever shares a bucket and is not yet in one component.
    links = _block_links(_blocks(_units(settled(_open_members(live, components))), sets), p.percent)
    components = connected_components(components.toDF("u", "v").union(links))

    labelled = signed.drop("keys").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = labelled.where("component is not null").groupBy("component").agg(F.min(F.struct(*_position())).alias("head"))
    alone = F.col("component").isNull()
    return labelled.join(heads, "component", "left").select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        (alone | (F.struct(*_position()) == F.col("head"))).alias("kept"),
        "text_hash",
    )


def keep_one_per_component(documents: DataFrame, params: NearDedup | None = None) -> DataFrame:
    """The rows of ``documents`` that stay, one per group, all columns as they are; of repeated rows one stays."""
    own, text, of, other = fresh(documents, "own", "text_hash", "of", "other")
    kept = near_components(documents, params).where("kept").select(F.col("doc_id").alias(of), F.col("text_hash").alias(other))
    rows = documents.withColumn(own, F.col("doc_id").cast("long")).withColumn(text, _text_hash())
    same = F.col(own).eqNullSafe(F.col(of)) & (F.col(text) == F.col(other))
    return rows.join(kept.distinct(), same, "left_semi").dropDuplicates([own, text]).drop(own, text)
