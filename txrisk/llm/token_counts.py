"""Token counts of a sentencepiece BPE model without tokenising documents.

No piece of the vocabulary holds a space mark after another character (checked when the model is
loaded), so merges never cross the place where a space follows a non-space: a text's token count is the sum over
its pre-tokens, each a run of spaces with the word after it. Distinct pre-tokens are counted once each; documents
only contribute pre-token frequencies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.session import ensure_checkpoint_dir, max_broadcast_bytes

SPACE_MARK = "▁"
#: A pre-token with at least 1 in this many occurrences is frequent, so there are at most so many of them. Where
#: even these pass the session's broadcast limit, the share is doubled until they fit.
FREQUENT = 1 << 22


def pre_tokens(text: Column) -> tuple[Column, Column]:
    """The text with plain spaces, and (over that as column ``plain``) what to split at spaces into pre-tokens.

    A pre-token is given without its first space; the model puts one before the text.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), SPACE_MARK, " ")
    # A space after a space belongs to the next word; split at the others.
    marked = F.expr("substring(regexp_replace(concat(' ', plain), '(?<= ) ', '▁'), 2)")
    runs = F.when(F.col("plain").startswith(" ") | F.col("plain").contains("  "), marked).otherwise(F.col("plain"))
    return plain, runs


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _exploded(documents: DataFrame) -> DataFrame:
    plain, runs = pre_tokens(F.col("text"))
    return (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("t"), plain.alias("plain"))
        .where("plain != ''")
        .select("doc_id", "t", F.posexplode(F.split(runs, " ", -1)).alias("at", "piece"))
        .select("doc_id", "t", (F.col("at") == 0).cast("long").alias("first"), "piece")
    )


def load_model(model_file: str):
    """The sentencepiece model, refused if pre-tokens could not be counted apart."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    crossing = re.compile(f"[^{SPACE_MARK}]{SPACE_MARK}")
    if any(crossing.search(model.id_to_piece(i)) for i in range(model.get_piece_size())):
        raise ValueError("the model has pieces that go on over a space")
    return model


def _counted(vocabulary: DataFrame, model_file: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model(model_file)
        for batch in batches:
            ids = model.encode(batch["piece"].tolist(), num_threads=1)
            # The lone space mark is one token, but encoding "" gives none.
            batch["tokens"] = [len(i) if piece else 1 for i, piece in zip(ids, batch["piece"])]
            yield batch

    return vocabulary.mapInPandas(run, "piece string, n long, tokens long")


def _bytes(vocabulary: DataFrame) -> int:
    return vocabulary.agg(F.coalesce(F.sum(F.octet_length("piece") + 48), F.lit(0))).first()[0]


def count_tokens(documents: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``documents(doc_id, text, ...)``.

    Counts equal ``encode`` of the whole text without begin and end tokens. Null counts as empty; an empty
    text has no tokens. Rows that repeat a doc_id, or have none, are counted each on its own. Other columns are
    ignored.

    Frequent pre-tokens (at most ``FREQUENT``, by their share of all occurrences, and a measured size) are joined by broadcast;
    the others, none of which is hot, meet their counts by shuffle.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    vocabulary = _exploded(documents).groupBy("piece").agg(F.count("*").alias("n"))
    vocabulary = _counted(vocabulary, model_file).checkpoint()
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = FREQUENT
    while _bytes(vocabulary.where(F.col("n") * share >= total)) > max_broadcast_bytes(documents.sparkSession):
        share //= 2
    frequent = vocabulary.where(F.col("n") * share >= total).select("piece", "tokens")
    rare = vocabulary.where(F.col("n") * share < total).select("piece", "tokens")

    # Rows that repeat id and text add up; each has one first pre-token, so the sum is shared out among them.
    rows = _exploded(documents)
    often = rows.join(F.broadcast(frequent), "piece").groupBy("doc_id", "t").agg(F.sum("tokens").alias("tokens"), F.sum("first").alias("rows"))
    seldom = (
        rows.join(F.broadcast(frequent.select("piece")), "piece", "left_anti")
        .repartition("piece")
        .groupBy("piece", "doc_id", "t")
        .agg(F.count("*").alias("times"), F.sum("first").alias("rows"))
        .join(rare, "piece")
        .groupBy("doc_id", "t")
        .agg(F.sum(F.col("times") * F.col("tokens")).alias("tokens"), F.sum("rows").alias("rows"))
    )
    sums = often.unionByName(seldom).groupBy("doc_id", "t")
    sums = sums.agg((F.sum("tokens") / F.sum("rows")).cast("long").alias("n_tokens")).alias("s")
    sizes = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _text_hash().alias("t"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    ).alias("d")
    n_tokens = F.coalesce("s.n_tokens", F.lit(0))
    return sizes.join(sums, F.expr("d.doc_id <=> s.doc_id and d.t = s.t"), "left").select(
        "d.doc_id", "d.n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
