"""Recurring line templates across documents, by a fixed-depth log-template tree.

The tree of a log parser in batch form. A line goes down by its token count and then by its leading tokens
(a token with a digit counts as variable). In the leaf it reaches, tokens are weighed by how many of the leaf's distinct
lines have them at that position. A line's log group is given by its best supported tokens, as many as must be
constant; its other tokens are the variable fields. So a leaf holds any number of groups, unrelated lines beside them
change nothing, and a field's value that happens to be frequent does not split its group. Lines of a group that occurs
in several documents are dropped. Nothing depends on the order of lines. Counts are combined map-side, so neither a
common line nor a crowded leaf is gathered anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.session import max_broadcast_bytes, scratch_path

VARIABLE = "<*>"


@dataclass(frozen=True)
class LineTree:
    """A template recurs from ``min_documents`` on; lines of fewer than ``min_tokens`` tokens are left alone.

    ``similar_percent``: share of a line's tokens that lines of its group have in common. A line with fewer tokens
    than that without a digit stands for itself.
    """

    leading: int = 3
    min_tokens: int = 3
    min_documents: int = 3
    similar_percent: int = 60


def masked(line: Column) -> Column:
    """Tokens of the line with one space between them; tokens with a digit are variable."""
    gaps = reduce(Column.__or__, (line.contains(gap) for gap in ("  ", "\t", "\r", "\x0b", "\x0c")))
    plain = F.trim(F.when(gaps, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", VARIABLE)).otherwise(plain)


def _digest(*c: Column) -> Column:
    """128 bits of two differently seeded hashes."""
    return F.struct(F.xxhash64(*c).alias("a"), F.xxhash64(F.lit(7), *c).alias("b"))


def _row_id(doc_id: Column, text: Column) -> Column:
    """The same for repeated rows, different for other texts under one doc_id."""
    return _digest(doc_id.cast("string").isNull(), F.coalesce(doc_id.cast("string"), F.lit("")), text)


def _lines(documents: DataFrame, p: LineTree) -> DataFrame:
    """row_id, line_no, leaf, key, line (masked), size; only lines of enough tokens, written once."""
    text = F.coalesce("text", F.lit(""))
    lines = documents.select(_row_id(F.col("doc_id"), text).alias("row_id"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    # A generator, so that the masked line is made once and not again for every use.
    lines = lines.select("row_id", "line_no", F.explode(F.array(masked(F.col("line")))).alias("line"))
    lines = lines.withColumn("size", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1)
    leaf = _digest(F.col("size"), F.substring_index("line", " ", p.leading))
    path = scratch_path(documents.sparkSession, "lines")
    kept = lines.where(F.col("size") >= p.min_tokens).select("row_id", "line_no", leaf.alias("leaf"), _digest(F.col("line")).alias("key"), "line", "size")
    kept.write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.parquet(path)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _generalised(lines: DataFrame, p: LineTree) -> DataFrame:
    """(key, template) for the distinct lines of leaves that hold several lines from several documents."""
    leaves = lines.groupBy("leaf").agg(
        F.min("row_id").alias("a"), F.max("row_id").alias("b"), F.min("key").alias("c"), F.max("key").alias("d")
    )
    crowded = _stored(leaves.where("a != b and c != d").select("leaf"), "leaves")
    if crowded.count() * 64 <= max_broadcast_bytes(lines.sparkSession):
        crowded = F.broadcast(crowded)  # else the lines are shuffled
    inside = lines.join(crowded, "leaf", "left_semi").groupBy("leaf", "key").agg(F.any_value("line").alias("line"), F.max("size").alias("size"))
    # A token at its place in its leaf is a 64-bit number from here on; variable ones are left out.
    marks = F.transform(F.split("line", " ", -1), lambda t, i: F.when(t != VARIABLE, F.xxhash64("leaf", i, t)))
    members = _stored(inside.select("key", "size", marks.alias("marks")), "members")
    tokens = members.select("key", "size", F.posexplode("marks").alias("at", "mark")).where(F.col("mark").isNotNull())
    support = tokens.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1")
    # Tokens of a single line have a support of one and need no lookup.
    weighed = tokens.join(support, "mark", "left").select(
        "key", "size", F.struct((-F.coalesce("n", F.lit(1))).alias("n"), "at", "mark").alias("t")
    )
    # A line's own tokens, gathered again.
    listed = weighed.groupBy("key", "size").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    wanted = F.ceil(F.col("size") * p.similar_percent / F.lit(100)).cast("int")
    best = F.array_sort(F.transform(F.slice("ts", 1, wanted), lambda t: t["mark"]))
    return listed.where(F.size("ts") >= wanted).select("key", _digest(F.lit("group"), F.col("size"), best).alias("template"))


def drop_recurring_lines(documents: DataFrame, params: LineTree | None = None) -> DataFrame:
    """doc_id, text, n_lines, n_dropped for every row of ``documents(doc_id, text, ...)``.

    Lines end at newlines; what is left is joined by newlines. Every occurrence of a recurring template goes, also
    repeats within a document. A null text is an empty text, which is one empty line. Rows that repeat both doc_id
    and text count as one document and are both returned; rows without a doc_id are documents by their text.
    Other columns are ignored. White space inside kept lines stays as it is.
    """
    p = params or LineTree()
    lines = _lines(documents, p)
    general = _generalised(lines, p)
    found = lines.select("row_id", "line_no", "key").join(general, "key", "left")
    found = _stored(found.select("row_id", "line_no", F.coalesce("template", "key").alias("template")), "templates")
    recurring = (
        found.select("template", "row_id").distinct().groupBy("template").agg(F.count("*").alias("n"))
        .where(F.col("n") >= p.min_documents).select("template")
    )
    dropped = found.join(recurring, "template").groupBy("row_id").agg(F.collect_set("line_no").alias("dropped"))

    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), _row_id(F.col("doc_id"), text).alias("row_id")).join(dropped, "row_id", "left")
    rows = rows.withColumn("lines", F.split("text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    rest = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    return rows.select(
        "doc_id",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(rest).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
