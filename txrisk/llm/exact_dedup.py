"""Exact duplicates by an extendible-hash index on shared files.

A text's key is its 64-bit hash. The directory maps leading key bits to buckets; a bucket over capacity is split
on its next bit, and the directory doubles when a bucket outgrows it. The index is a table in the shared
folder, one partition per bucket. An owner task holds the keys of one bucket (a key range) and chains the entries of
equal keys. Entries are distinct texts: copies are merged before they are inserted, by comparing bytes, so a text
with very many copies is one entry and can't overfill a bucket. Looking a document up reads its bucket's range and
follows the chain. All of it is column expressions, joins and aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.columns import fresh
from txrisk.session import max_broadcast_bytes, scratch_path


@dataclass(frozen=True)
class ExtendibleHash:
    """``capacity``: entries a bucket holds; ``first_depth``: bits of the directory before any split."""

    capacity: int = 1 << 18
    first_depth: int = 6


def _bits(depth: int) -> Column:
    """The leading bits of the key, as a string of 0 and 1."""
    return F.substring(F.lpad(F.bin("key"), 64, "0"), 1, depth)


def _entries(documents: DataFrame) -> DataFrame:
    """One row per distinct text, told apart by its bytes: key, text_sha256, keep_id, group_size, n_bytes."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    merged = rows.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return merged.select(
        "key", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size", F.octet_length("text").alias("n_bytes")
    )


def directory(keys: DataFrame, p: ExtendibleHash) -> tuple[DataFrame, int]:
    """(cell, bucket) for every cell of the doubled directory that holds keys, and the directory's depth.

    A bucket is named by its leading bits: the shortest run of at least ``first_depth`` bits that holds no more than
    ``capacity`` keys. The directory is as deep as its deepest bucket; keys that equal each other in all bits looked
    at stay together, as an overflow chain.
    """
    n = keys.count()
    deepest = min(60, p.first_depth + max(0, (n // p.capacity).bit_length()) + 3)
    cells = keys.groupBy(_bits(deepest).alias("cell")).agg(F.count("*").alias("n"))
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(p.first_depth), F.lit(deepest))).alias("depth"))
    levels = levels.withColumn("bucket", F.expr("substring(cell, 1, depth)"))
    fitting = levels.groupBy("bucket", "depth").agg(F.sum("n").alias("n")).where((F.col("n") <= p.capacity) | (F.col("depth") == deepest))
    local = levels.select("cell", "bucket", "depth").join(fitting.select("bucket", "depth"), ["bucket", "depth"])
    return local.groupBy("cell").agg(F.min_by("bucket", "depth").alias("bucket")), deepest


def _with_bucket(rows: DataFrame, cells: DataFrame, depth: int) -> DataFrame:
    return rows.withColumn("cell", _bits(depth)).join(cells, "cell").drop("cell")


def build_index(documents: DataFrame, params: ExtendibleHash | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The index of the distinct texts, read back from the shared folder, with its directory and depth.

    Index columns: bucket, key, chain (place among the entries of an equal key), text_sha256, keep_id, group_size,
    n_bytes.
    """
    p = params or ExtendibleHash()
    spark = documents.sparkSession
    loose = scratch_path(spark, "entries")
    _entries(documents).write.parquet(loose)
    entries = spark.read.parquet(loose)
    cells, depth = directory(entries.select("key"), p)
    folder = scratch_path(spark, "directory")
    cells.write.parquet(folder)
    cells = spark.read.parquet(folder)
    if cells.count() * (depth + 64) <= max_broadcast_bytes(spark):
        cells = F.broadcast(cells)
    owned = _with_bucket(entries, cells, depth).withColumn("bucket", F.concat(F.lit("b"), "bucket")).repartition("bucket")
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text_sha256"))
    path = scratch_path(spark, "index")
    owned = owned.withColumn("chain", chain)
    owned.write.partitionBy("bucket").parquet(path)
    return spark.read.schema(owned.schema).parquet(path), cells, depth


def exact_groups(documents: DataFrame, params: ExtendibleHash | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``documents(doc_id, text, ...)``.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the largest doc_id stays. Rows
    that repeat it are all marked kept; rows without a doc_id are kept only where no equal text has one. Other columns
    are ignored.
    """
    index, cells, depth = build_index(documents, params)
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("text_sha256")
    )
    probes = _with_bucket(rows, cells, depth).withColumn("bucket", F.concat(F.lit("b"), "bucket"))
    found = probes.join(index.select("bucket", "key", "text_sha256", "keep_id", "group_size"), ["bucket", "key", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one_of_equal(documents: DataFrame, params: ExtendibleHash | None = None) -> DataFrame:
    """The rows of ``documents`` that stay, all columns as they are; of repeated rows one stays."""
    index, _, _ = build_index(documents, params)
    sha, own, of, keep = fresh(documents, "sha", "own", "of", "keep")
    stay = index.select(F.col("text_sha256").alias(of), F.col("keep_id").alias(keep))
    rows = documents.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn(own, F.col("doc_id").cast("long"))
    rows = rows.join(stay, (F.col(sha) == F.col(of)) & F.col(own).eqNullSafe(F.col(keep)))
    return rows.dropDuplicates([sha, own]).drop(sha, own, of, keep)
