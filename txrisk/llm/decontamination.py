"""Benchmark decontamination: containment search by the smallest shingle hashes.

A document contains an item when it has at least ``percent`` of the item's distinct word shingles; an item of fewer
words than a shingle is one run of its own length. Items are partitioned by size (powers of two of their shingles,
and each run length of short ones). An item's sketch is its k smallest shingle hashes, where k is one more than the
shingles a containing document may lack: a document that contains the item has at least one of them, whatever its own
length, so the search loses nothing. Each partition is searched with its own bound on hashes, and only in
documents long enough to contain its smallest item. Finds are verified by counting shared shingles, word for word.

One minimum per permutation and document, with bands, would need thousands of permutations to find an item of forty
shingles in a document of twenty thousand; the k smallest hashes of the short side do not have that weakness. All
of it is column expressions and joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.columns import fresh
from txrisk.session import max_broadcast_bytes, scratch_path


@dataclass(frozen=True)
class Containment:
    shingle_words: int = 5
    percent: int = 80


def words(text: Column) -> Column:
    """Lower-case words; everything but letters and digits is a gap.

    A generator: the list becomes a column of its own, which the optimizer can't copy into the lambdas that read it.
    """
    cut = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.explode(F.array(cut))


def run_hashes(w: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words, none of a shorter text."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
    return F.when(F.size(w) >= n, runs).otherwise(F.array().cast("array<bigint>"))


def run_texts(w: Column, n: int) -> Column:
    """The distinct runs of ``n`` words themselves."""
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return F.when(F.size(w) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _hashes_of(texts: str, n: int) -> Column:
    """``run_hashes`` of runs given as texts."""

    def of(t: Column) -> Column:
        parts = F.split(t, " ")
        return F.xxhash64(*(F.get(parts, F.lit(k)) for k in range(n)))

    return F.transform(texts, of)


def item_shingles(benchmark: DataFrame, p: Containment) -> DataFrame:
    """item, item_id, run, n_item, need, texts, hashes per distinct item; ``need`` of its shingles make a find.

    ``run`` is the words of a shingle: ``shingle_words``, or all of a shorter item.
    """
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    items = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("run", F.least(F.size("w"), F.lit(p.shingle_words)))
    by_run = [F.when(F.col("run") == n, run_texts(F.col("w"), n)) for n in range(1, p.shingle_words + 1)]
    items = items.select("item_id", "run", F.coalesce(*by_run).alias("texts"))
    by_words = [F.when(F.col("run") == n, _hashes_of("texts", n)) for n in range(1, p.shingle_words + 1)]
    items = items.withColumn("hashes", F.coalesce(*by_words)).withColumn("n_item", F.size("texts").cast("long"))
    items = items.withColumn("need", F.floor((F.col("n_item") * p.percent + 99) / 100).cast("long"))
    return items.withColumn("item", F.xxhash64("item_id", F.array_sort("texts")))


def sketches(items: DataFrame) -> DataFrame:
    """run, size_class, need (the least of the class), shingle: the k smallest hashes of every item, k by its size."""
    k = (F.col("n_item") - F.col("need") + 1).cast("int")
    size_class = F.ceil(F.log2(F.col("n_item"))).cast("int")
    rows = items.select("run", size_class.alias("size_class"), "need", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), k)).alias("shingle"))
    return rows.groupBy("run", "size_class", "shingle").agg(F.min("need").alias("need"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder: small ones are then known to be small."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _small(df: DataFrame, text: int = 0) -> DataFrame:
    """Hint a broadcast for a stored table that the session's limit admits; ``text`` is the width of its words."""
    width = 16 * len(df.columns) + text
    return F.broadcast(df) if df.count() * width <= max_broadcast_bytes(df.sparkSession) else df


def contained_items(documents: DataFrame, benchmark: DataFrame, params: Containment | None = None) -> DataFrame:
    """doc_id, text_hash, item_id, n_shared, n_item, containment: one row per document and item it contains.

    ``documents(doc_id, text, ...)`` and ``benchmark(item_id, text, ...)`` may have other columns. Null and wordless
    texts contain nothing and are contained in nothing. An item of fewer words than a shingle is found wherever its
    words stand in a row. Repeated rows count once; items that repeat an item_id with another text are tested each on
    its own. Rows without a doc_id are found as null. ``text_hash`` tells texts under one doc_id apart.
    """
    p = params or Containment()
    items = _stored(item_shingles(benchmark, p), "items")
    item_rows = _stored(items.select("item", "item_id", "n_item", "need", F.explode("texts").alias("shingle")).distinct(), "item-shingles")
    keys = _stored(sketches(items), "sketches")
    # As many rows as powers of two fit the largest item, and as there are words in a shingle.
    classes = keys.groupBy("run", "size_class").agg(F.max("shingle").alias("bound"), F.min("need").alias("need")).collect()

    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    listed = rows.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    found = None
    for run in sorted({c["run"] for c in classes}):
        runs = F.size("w") - run + 1
        bounds = [F.when(runs >= c["need"], F.lit(c["bound"])) for c in classes if c["run"] == run]
        bound = F.greatest(*bounds) if len(bounds) > 1 else bounds[0]
        looked_up = F.filter(run_hashes(F.col("w"), run), _at_most(bound))
        probes = listed.select("doc_id", "text_hash", runs.alias("runs"), F.explode(looked_up).alias("shingle"))
        mine = keys.where(F.col("run") == run).groupBy("shingle").agg(F.min("need").alias("need"))
        hits = probes.join(_small(_stored(mine, "partition")), "shingle").where("runs >= need").select("doc_id", "text_hash")
        found = hits if found is None else found.union(hits)
    if found is None:
        found = listed.select("doc_id", "text_hash").limit(0)
    found = _stored(found.distinct().select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")), "candidates")

    whole = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_semi")
    whole = whole.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    texts = [run_texts(F.col("w"), run) for run in sorted({c["run"] for c in classes})]
    every = F.concat(*texts) if texts else F.array().cast("array<string>")
    whole = whole.select("doc_id", "text_hash", F.explode(every).alias("shingle"))
    shared = whole.join(_small(item_rows, 80), "shingle").select("doc_id", "text_hash", "item", "item_id", "n_item", "need", "shingle")
    counted = shared.distinct().groupBy("doc_id", "text_hash", "item", "item_id", "n_item", "need").agg(F.count("*").alias("n_shared"))
    return counted.where("n_shared >= need").select(
        "doc_id", "text_hash", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )


def _at_most(bound: Column):
    return lambda h: h <= bound


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, params: Containment | None = None) -> DataFrame:
    """The rows of ``documents`` that contain no item, all columns as they are."""
    of, other = fresh(documents, "of", "other")
    found = contained_items(documents, benchmark, params).select(F.col("doc_id").alias(of), F.col("text_hash").alias(other))
    found = _stored(found.distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(other))
    return documents.join(found, same, "left_anti")
