"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes when it is covered by a string of ``width`` bytes that also starts earlier. Finding all such strings takes
an order of suffixes up to that depth. One order over the whole corpus would be one task's work, so the text is
first dealt out such that equal strings meet:

1. Every window of ``width`` bytes picks its smallest hash among its runs of ``anchor`` bytes. Equal windows pick the
   same run at the same place. Picked runs that occur once in the corpus can't be in a repeated window.
2. Around each occurrence of a repeated run the bytes of all windows that may have picked it are cut out (a context).
   Equal contexts (by a 128-bit digest) are merged by Spark: all but the first occurrence are covered.
3. Contexts that differ are dealt by run. In each dealt portion shards of contexts get a suffix order and a
   Burrows-Wheeler transform of their own. The transforms are merged by refining their interleave: reading the
   symbols in the order reached so far and dealing them stably by symbol sorts by one symbol more (two are read at
   once where few enough occur). The round in which two neighbours part tells their common prefix; after ``width``
   symbols, what is still together is a repeated
   interval. No suffix of another shard is looked at and none is sorted again.
4. A run with very many different contexts is cut into its windows, which Spark groups by their bytes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.batches import small_batches
from txrisk.llm.text_hash import window_hashes
from txrisk.session import ensure_checkpoint_dir, max_broadcast_bytes, scratch_path, settings


@dataclass(frozen=True)
class RepeatedStrings:
    """``width`` is at most 255. ``portion``: contexts per merge task, about; ``hot``: contexts of one run from which it is cut into windows;
    ``shard``: contexts per transform before merging."""

    width: int = 100
    anchor: int = 24
    portion: int = 8192
    hot: int = 8192
    shard: int = 1024


_NO_ID = (1 << 63) - 1


# -- anchors -----------------------------------------------------------------------------------------------------


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    out = h
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    n = len(h) - width + 1
    return out[:n] if span == width else np.minimum(out[:n], out[width - span : width - span + n])


def picked_runs(data: np.ndarray, p: RepeatedStrings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and hash of the runs that windows of the data pick, with the first and last start of those windows.

    Of equal smallest hashes in a window all places count, so equal windows pick alike. The windows that pick a
    place are those around it without a smaller hash, which follow each other.
    """
    h = window_hashes(data, p.anchor)
    span = p.width - p.anchor + 1
    if len(h) < span:
        none = np.empty(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    least = _sliding_min(h, span)
    # The largest minimum of the windows around a place equals its hash if and only if one of them picks it.
    edge = np.zeros(span - 1, dtype=np.uint64)
    around = ~_sliding_min(~np.concatenate([edge, least, edge]), span)
    at = np.flatnonzero(h == around)
    # Stretches of windows with one minimum; a place's windows are in the first one in reach that has its hash.
    begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(begins[1:], len(least)) - 1
    stretch = np.searchsorted(ends, at - span + 1)
    while True:
        wrong = least[begins[stretch]] != h[at]
        if not wrong.any():
            break
        stretch[wrong] += 1
    return at, h[at], np.maximum(begins[stretch], at - span + 1), np.minimum(ends[stretch], at)


# -- Burrows-Wheeler transforms ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Transform:
    """A shard's suffix order with its transform; all arrays go by row.

    ``place`` is where the row's suffix begins in the joined strings, ``symbol`` the byte + 1 before it (0 before a
    string's first byte), ``step`` the row of the suffix that has this symbol in front.
    """

    row_of: np.ndarray
    place: np.ndarray
    symbol: np.ndarray
    step: np.ndarray


def transform_of(strings: list[bytes], depth: int) -> Transform:
    """The transform of a shard: its suffixes in order up to at least ``depth`` symbols.

    Every string has an end mark, smaller than any byte and smaller than the marks of later strings.
    """
    if len(strings) > 1024:
        raise ValueError("a shard has at most 1024 strings, so that six symbols fit a key")
    joined = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
    n = len(joined)
    marks = np.cumsum(np.fromiter(map(len, strings), dtype=np.int64, count=len(strings)) + 1) - 1
    symbols = joined.astype(np.int64) + 1
    symbols[marks] = 0
    rank = symbols + len(strings)
    rank[marks] = np.arange(len(strings))
    known = 1
    while True:
        order = np.argsort(rank)
        ordered = rank[order]
        rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
        if known >= depth or rank[order[-1]] == n - 1:
            break
        base = n + 1 if known > 1 else 257 + len(strings)
        wide = 6 if known == 1 else 3 if base**3 < 1 << 63 else 2
        key = rank.copy()
        for i in range(1, wide):
            key *= base
            if i * known < n:
                key[: n - i * known] += rank[i * known :] + 1
        rank, known = key, known * wide
    row_of = np.empty(n, dtype=np.int64)
    row_of[order] = np.arange(n)
    return Transform(row_of, order, symbols[order - 1], row_of[order - 1])


def repeated_starts(strings: list[bytes], width: int, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of equal windows of ``width`` bytes: string number, start, and the number of the interval they share.

    Shards are merged by refining the interleave of their rows. A round takes the rows in the order reached, which is
    by their first symbols, and deals them stably by the symbol before; one step on, they are in order by one symbol
    more. (Two symbols are dealt as one where a pair of them fits 16 bits.) Neighbours with another symbol, or from parts that were apart already, part here, and the round is the length
    of their common prefix. A row that parts from both its neighbours can't get an equal again, nor can any row it
    steps to, so only rows that are still together go on; and only rows from which a window's start is yet to be
    reached begin. After ``width`` symbols the parts are the repeated intervals.
    """
    of_string, start_of, begin, base = [], [], [], 0
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    symbols, steps = [], []
    for at in range(0, len(strings), shard):
        t = transform_of(strings[at : at + shard], width)
        sizes = lengths[at : at + shard] + 1
        number = np.repeat(np.arange(len(sizes)), sizes)
        start = np.arange(len(t.place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # Rows of the last bytes of windows, the only ones that may reach a window's start.
        last = np.flatnonzero((start >= width - 1) & (start < sizes[number] - 1))
        begin.append(np.sort(t.row_of[last]) + base)
        of_string.append(number[t.place] + at)
        start_of.append(start[t.place])
        symbols.append(t.symbol.astype(np.uint16))
        steps.append(t.step + base)
        base += len(t.place)
    symbol, step = np.concatenate(symbols), np.concatenate(steps)
    rows = np.concatenate(begin)
    # Shard by shard in order; dealt by first symbols, the interleave of the first round.
    first = symbol_in_front(rows, symbol, step)
    rows = rows[np.argsort(first, kind="stable")]
    part = np.sort(first).astype(np.int32)
    rows, part = _still_together(rows, part)
    known = 1
    if width % 2 == 0:
        rows, part = _dealt(rows, part, symbol, step)
        known += 1
    # What is left to read is even: two symbols at a time, numbered by those that occur so that a pair is dealt by a
    # radix sort.
    occurs = np.zeros(257, dtype=bool)
    occurs[symbol] = True
    number = np.cumsum(occurs) - 1
    two = 2 if number[-1] < 256 else 1
    if two == 2:
        dense = number.astype(np.uint16)[symbol]
        symbol = dense[step] * np.uint16(number[-1] + 1) + dense
        step = step[step]
    for _ in range(known, width, two):
        if not len(rows):
            break
        rows, part = _dealt(rows, part, symbol, step)
    return np.concatenate(of_string)[rows], np.concatenate(start_of)[rows], part


def _dealt(rows: np.ndarray, part: np.ndarray, symbol: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: the rows one step on, in their new order and parts, without those that are alone."""
    dealt = symbol[rows]
    order = np.argsort(dealt, kind="stable")
    dealt, part = dealt[order], part[order]
    new = np.empty(len(part), dtype=bool)
    new[:1] = False
    np.not_equal(dealt[1:], dealt[:-1], out=new[1:])
    new[1:] |= part[1:] != part[:-1]
    # A row is alone where a part begins with it and the next one begins after it.
    alone = np.empty(len(part), dtype=bool)
    alone[:1], alone[1:] = True, new[1:]
    alone[:-1] &= new[1:]
    keep = np.flatnonzero(~alone)
    return step[rows[order[keep]]], np.cumsum(new, dtype=np.int32)[keep]


def symbol_in_front(rows: np.ndarray, symbol: np.ndarray, step: np.ndarray) -> np.ndarray:
    """First symbols of rows: what the transform has before the row that steps to them."""
    first = np.empty_like(symbol)
    first[step] = symbol
    return first[rows]


def _still_together(rows: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    same = part[1:] == part[:-1]
    keep = np.zeros(len(part), dtype=bool)
    keep[1:] |= same
    keep[:-1] |= same
    return rows[keep], part[keep]


def later_places(place: np.ndarray, interval: np.ndarray) -> np.ndarray:
    """Sorted distinct places that aren't the first one of an interval; equal intervals follow each other."""
    if not len(place):
        return place
    at = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    first = np.repeat(np.minimum.reduceat(place, at), np.diff(np.append(at, len(place))))
    return np.unique(place[place != first])


# -- the Spark job -----------------------------------------------------------------------------------------------


def _texts(documents: DataFrame) -> DataFrame:
    """doc_id, d (never null), t (tells texts under one id apart), raw bytes."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("d"),
        F.xxhash64(raw).alias("t"),
        raw.alias("raw"),
    )


def _anchors(texts: DataFrame, p: RepeatedStrings) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                runs = [picked_runs(np.frombuffer(raw, dtype=np.uint8), p) for raw in part["raw"]]
                sizes = [len(found[0]) for found in runs]
                at_place, hashes, low, high = (np.concatenate(x) for x in zip(*runs))
                yield pd.DataFrame(
                    {
                        "d": np.repeat(part["d"].to_numpy(), sizes),
                        "t": np.repeat(part["t"].to_numpy(), sizes),
                        "at": at_place.astype(np.int32),
                        "run": hashes.view(np.int64),
                        # How far the windows that pick the run reach to its left and right.
                        "reach": ((at_place - low) * 256 + (high + p.width - at_place)).astype(np.int32),
                    }
                )

    return texts.where(F.octet_length("raw") >= p.width).select("d", "t", "raw").mapInPandas(run, "d long, t long, at int, run long, reach int")


def _contexts(placed: DataFrame, p: RepeatedStrings) -> DataFrame:
    """run, digest (of context and place in it), left (bytes before the run), d, t, begin, stop."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                rows = []
                part = (batch[c].iloc[at : at + 200] for c in ("d", "t", "raw", "places", "runs", "reaches"))
                for d, t, raw, places, runs, reaches in zip(*part):
                    for place, found, reach in zip(places.tolist(), runs.tolist(), reaches.tolist()):
                        left, right = divmod(reach, 256)
                        digest = xxhash.xxh3_128_digest(raw[place - left : place + right], seed=left)
                        rows.append((found, digest, left, d, t, place - left, place + right))
                yield pd.DataFrame(rows, columns=["run", "digest", "left", "d", "t", "begin", "stop"])

    return placed.select("d", "t", "raw", "places", "runs", "reaches").mapInPandas(
        run, "run long, digest binary, left int, d long, t long, begin int, stop int"
    )


def _cut_out(firsts: DataFrame, texts: DataFrame) -> DataFrame:
    """run, kinds, left, d, t, begin, context for ``firsts``, the bytes taken from their documents."""
    columns = ["run", "kinds", "left", "begin", "stop"]
    listed = firsts.groupBy("d", "t").agg(*[F.collect_list(c).alias(c) for c in columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part, rows = batch.iloc[at : at + 200], []
                for d, t, raw, *lists in zip(part["d"], part["t"], part["raw"], *(part[c] for c in columns)):
                    rows += [(r, k, left, d, t, b, raw[b:e]) for r, k, left, b, e in zip(*(x.tolist() for x in lists))]
                yield pd.DataFrame(rows, columns=["run", "kinds", "left", "d", "t", "begin", "context"])

    return texts.join(listed, ["d", "t"]).select("d", "t", "raw", *columns).mapInPandas(
        run, "run long, kinds long, left int, d long, t long, begin int, context binary"
    )


#: Spark removes what a query shuffled when the query ends, not when the driver next collects garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a compressed table in the shared folder; the shuffles behind it are not kept."""
    path = scratch_path(df.sparkSession, name)
    with settings(df.sparkSession, {_CLEAN_UP: "true"}):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _may_share(part: pd.DataFrame, p: RepeatedStrings) -> np.ndarray:
    """Contexts that may have a window in common with another of their run.

    Such a window holds the run and either the bytes left of it or those right of it, up to half of what fits.
    """
    half = (p.width - p.anchor) // 2
    sides: list[list] = [[], []]
    for run, context, left in zip(part["run"], part["context"], part["left"]):
        sides[0].append((run, context[left - half : left + p.anchor]) if left >= half else None)
        sides[1].append((run, context[left : left + p.anchor + half]) if len(context) >= left + p.anchor + half else None)
    keep = np.zeros(len(part), dtype=bool)
    for side in sides:
        counts = Counter(side)
        keep |= np.fromiter((key is not None and counts[key] > 1 for key in side), dtype=bool, count=len(side))
    return keep


def _later_copies(texts: DataFrame) -> DataFrame:
    """d, t, n_bytes of the documents whose whole text another document has that comes first."""
    rows = texts.select("d", "t", F.sha2("raw", 256).alias("sha"), F.octet_length("raw").alias("n_bytes"))
    first = rows.groupBy("sha").agg(F.min(F.struct("d", "t")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = rows.join(first, "sha").where(F.struct("d", "t") != F.col("first")).select("d", "t", "n_bytes").distinct()
    return later.checkpoint()


def _covered(texts: DataFrame, p: RepeatedStrings) -> DataFrame:
    """d, t, begin, stop: stretches of bytes that are covered by a string that also starts earlier."""
    later = _later_copies(texts)
    if later.count() * 64 <= max_broadcast_bytes(texts.sparkSession):
        # Not needed for the result: contexts of whole copies would be merged below.
        texts = texts.join(F.broadcast(later.select("d", "t")), ["d", "t"], "left_anti")
    # Counted in place: the texts are hashed once and the runs travel once.
    anchors = _anchors(texts, p).withColumn("n", F.count("*").over(Window.partitionBy("run")))
    found = anchors.where("n > 1").groupBy("d", "t")
    found = found.agg(F.collect_list("at").alias("places"), F.collect_list("run").alias("runs"), F.collect_list("reach").alias("reaches"))
    contexts = _stored(_contexts(texts.select("d", "t", "raw").join(found, ["d", "t"]), p), "contexts")

    place = F.struct("d", "t", "begin")
    first = F.struct("d", "t", "begin", "left", "stop")
    merged = contexts.groupBy("run", "digest").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    merged = _stored(merged, "merged")
    copies = (
        contexts.select("digest", "d", "t", "begin", "stop")
        .where(F.col("stop") - F.col("begin") >= p.width)
        .join(merged.where("n > 1").select("digest", "first"), "digest")  # of equal contexts, so of one run
        .where((F.col("d") != F.col("first.d")) | (F.col("t") != F.col("first.t")) | (F.col("begin") != F.col("first.begin")))
        .select("d", "t", "begin", "stop")
    )

    kinds = merged.groupBy("run").agg(F.count("*").alias("kinds")).where("kinds > 1")
    firsts = _stored(merged.join(kinds, "run").select("run", "kinds", "first.*"), "firsts")
    usual = F.col("kinds") <= p.hot
    portions = max(1, -(-firsts.where(usual).count() // p.portion))
    dealt = _cut_out(firsts.where(usual), texts.select("d", "t", "raw"))
    dealt = dealt.withColumn("portion", F.pmod(F.xxhash64("run"), F.lit(portions)))

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part[_may_share(part, p)].sort_values(["d", "t", "begin"], ignore_index=True)
        if not len(part):
            return pd.DataFrame({"d": [], "t": [], "begin": [], "stop": []})
        string, start, interval = repeated_starts([bytes(c) for c in part["context"]], p.width, p.shard)
        d, t, begin = (part[c].to_numpy() for c in ("d", "t", "begin"))
        # Contexts go by document, so a document's number and a place in it are in the order of first places.
        document = np.cumsum(np.concatenate([[False], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
        head = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1]]))
        place = later_places((document[string] << 32) + begin[string] + start, interval)
        # Starts that overlap or touch become one stretch; a document's last start is far from the next one's first.
        new = np.flatnonzero(np.diff(place, prepend=-1 - p.width) > p.width)
        last = place[np.append(new[1:], len(place)) - 1] if len(new) else place
        first, low = head[place[new] >> 32], (1 << 32) - 1
        return pd.DataFrame({"d": d[first], "t": t[first], "begin": place[new] & low, "stop": (last & low) + p.width})

    within = _stored(dealt.groupBy("portion").applyInPandas(merge, "d long, t long, begin long, stop long"), "within")

    shifts = F.sequence(F.lit(0), F.octet_length("context") - p.width)
    windows = (
        _cut_out(firsts.where(~usual), texts.select("d", "t", "raw"))
        .select("d", "t", "begin", "context", F.explode(shifts).alias("shift"))
        .select("d", "t", (F.col("begin") + F.col("shift")).alias("begin"), F.expr(f"substring(context, shift + 1, {p.width})").alias("window"))
    )
    source = windows.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    hot = (
        windows.join(source, "window")
        .where(place != F.col("first"))
        .select("d", "t", "begin", (F.col("begin") + p.width).alias("stop"))
    )
    whole = later.where(F.col("n_bytes") >= p.width).select("d", "t", F.lit(0).alias("begin"), F.col("n_bytes").alias("stop"))
    covered = copies.unionByName(within).unionByName(whole)
    return covered if firsts.where(~usual).isEmpty() else covered.unionByName(hot)


def remove_repeats(documents: DataFrame, params: RepeatedStrings | None = None, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept for every row of ``documents(doc_id, text, ...)``.

    Texts are their UTF-8 bytes, a null text has none. Earlier means a smaller doc_id, or an earlier start in the same
    document; rows without a doc_id come last, and texts under one doc_id are ordered by a hash. Rows that repeat both
    doc_id and text are one document and get the same result each. ``kept`` are the bytes that are left (null when
    ``with_bytes`` is false); they need not be valid UTF-8. Other columns are ignored.
    """
    p = params or RepeatedStrings()
    ensure_checkpoint_dir(documents.sparkSession)
    small_batches(documents.sparkSession)
    texts = _texts(documents)
    spans = _covered(texts, p).groupBy("d", "t").agg(F.collect_list("begin").alias("begins"), F.collect_list("stop").alias("stops"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part, rows = batch.iloc[at : at + 500], []
                for raw, begins, stops in zip(part["raw"], part["begins"], part["stops"]):
                    row = _cut(raw, begins, stops)
                    rows.append(row if with_bytes else (*row[:4], None))
                out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
                out.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
                yield out

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return texts.join(spans, ["d", "t"], "left").select("doc_id", "raw", "begins", "stops").mapInPandas(run, schema)


def _cut(raw: bytes, begins, stops) -> tuple[int, int, int, str, bytes]:
    """Sizes and the rest of a text after removing stretches, which may overlap."""
    if begins is None or not len(begins):
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw
    rest, end, removed, n = [], 0, 0, 0
    last = -1
    for begin, stop in sorted(zip(begins.tolist(), stops.tolist())):
        if begin > last:
            n += 1
            rest.append(raw[max(last, 0) : begin])
            removed += stop - begin
            last = stop
        elif stop > last:
            removed += stop - last
            last = stop
    rest.append(raw[last:])
    kept = b"".join(rest)
    return len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept
