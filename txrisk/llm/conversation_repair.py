"""Repair of the role structure of conversations.

Every row of a conversation is a symbol: its role's initial, and whether the row has to go (blank or seen earlier) or
ends in mid-sentence. The cheapest edits that give the roles ``(s?(ua)+)?`` are a shortest path through a four-state
automaton, so a run of rows is a min-plus transfer matrix over its states, each entry a cost and the edits' initials
as a rope. Runs that recur are Re-Pair rules: a rule's matrix is the product of the matrices of its two halves, made
once and shared by all conversations that hold it.

Rows are sorted over the cluster by conversation and turn with Spark's range partitioner, so one long conversation
takes several partitions; each gives matrices for pieces of bounded length, and the pieces of a conversation are
multiplied in order. Only the digest of the repaired text reads the texts in order, as a stream.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from txrisk.session import scratch_path

#: Rows of a conversation that one matrix stands for, at most.
PIECE = 256
#: Distinct pieces whose matrices a task remembers.
REMEMBERED = 20_000

#: The costs of the edits.
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5

#: States of the automaton for ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
_STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ACCEPTED = (START, ASSISTANT)

_SPACE = " \t\n\x0b\x0c\r"

Rope = str | tuple
Entry = tuple[int, Rope] | None
Matrix = tuple[Entry, ...]


def _flat(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        top = todo.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            todo += (top[1], top[0])
    return "".join(out)


def _better(a: Entry, b: Entry) -> Entry:
    """The cheaper entry; of equal costs the one whose edits are ASCII-least."""
    if a is None or (b is not None and b[0] < a[0]):
        return b
    if b is None or a[0] < b[0]:
        return a
    return b if _flat(b[1]) < _flat(a[1]) else a


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; ropes are joined, not copied."""
    out: list[Entry] = []
    for p in range(STATES):
        for q in range(STATES):
            best: Entry = None
            for m in range(STATES):
                x, y = a[STATES * p + m], b[STATES * m + q]
                if x is not None and y is not None:
                    best = _better(best, (x[0] + y[0], (x[1], y[1])))
            out.append(best)
    return tuple(out)


def _insertions() -> Matrix:
    """Empty rows put in between two states: the fewest lead there, no state twice."""
    best: list[Entry] = [(0, "") if p == q else None for p in range(STATES) for q in range(STATES)]
    for _ in range(STATES):
        for p in range(STATES):
            for role in "ua":
                for m, q in _STEP[role].items():
                    way = best[STATES * p + m]
                    if way is not None:
                        best[STATES * p + q] = _better(best[STATES * p + q], (way[0] + INSERT, way[1] + "I"))
    return tuple(best)


INSERTIONS = _insertions()
#: A row that has to go, and the eight kinds that may stay: role initial, upper case if it ends in mid-sentence.
GONE = "-"
SYMBOLS = GONE + "suaxSUAX"


def _row_matrix(symbol: str) -> Matrix:
    """Insertions before the row, then the row kept, given another role or deleted."""
    row: list[Entry] = [(DELETE, "D") if p == q else None for p in range(STATES) for q in range(STATES)]
    if symbol != GONE:
        extra = UNFINISHED if symbol.isupper() else 0
        for edit, cost, roles in (("K", extra, symbol.lower()), ("R", extra + REROLE, "ua")):
            for role in roles:
                for p, q in _STEP.get(role, {}).items():
                    row[STATES * p + q] = _better(row[STATES * p + q], (cost, edit))
    return product(INSERTIONS, tuple(row))


ROW_MATRICES = {s: _row_matrix(s) for s in SYMBOLS}


def re_pair(sequences: Iterable[str]) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """(sequences over symbols and rules, rules): the most frequent pair becomes a rule until none occurs twice.

    Symbols 0.. are SYMBOLS, rule i is symbol ``len(SYMBOLS) + i``. Ties go to the smaller pair.
    """
    coded = [[SYMBOLS.index(c) for c in s] for s in sequences]
    rules: list[tuple[int, int]] = []
    while True:
        pairs: Counter = Counter()
        for s in coded:
            pairs.update(zip(s, s[1:]))
        if not pairs:
            return coded, rules
        pair, count = min(pairs.items(), key=lambda kv: (-kv[1], kv[0]))
        if count < 2:
            return coded, rules
        name = len(SYMBOLS) + len(rules)
        rules.append(pair)
        left, right = pair
        for i, s in enumerate(coded):
            if left not in s:
                continue
            out, at, last = [], 0, len(s) - 1
            while at <= last:
                if at < last and s[at] == left and s[at + 1] == right:
                    out.append(name)
                    at += 2
                else:
                    out.append(s[at])
                    at += 1
            coded[i] = out


def matrices(sequences: Iterable[str]) -> dict[str, Matrix]:
    """The transfer matrix of each sequence, evaluated bottom-up over their common grammar."""
    distinct = sorted(set(sequences))
    coded, rules = re_pair(distinct)
    known = [ROW_MATRICES[s] for s in SYMBOLS]
    for left, right in rules:
        known.append(product(known[left], known[right]))
    out = {}
    for text, s in zip(distinct, coded):
        whole = None
        for symbol in s:
            whole = known[symbol] if whole is None else product(whole, known[symbol])
        out[text] = whole if whole is not None else tuple((0, "") if p == q else None for p in range(STATES) for q in range(STATES))
    return out


# ---- rows to symbols -----------------------------------------------------------------------


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def _body(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACE))


PIECES = (
    "conv_id {id}, part long, piece long, first string, last string, lowest long, highest long, turns long, blank long, "
    "duplicate long, truncated long, illegal long, cost array<long>, audit array<string>"
)
REPAIRED = (
    "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
_MOST, _LEAST = 2**63 - 1, -(2**63)
_LEGAL = {"su", "ua", "au"}


@dataclass
class _Piece:
    """Counts of a run of rows, and its symbols so far."""

    symbols: list[str]
    first: str | None = None
    last: str | None = None
    lowest: int | None = None
    highest: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0

    def add(self, turn: int | None, initial: str, symbol: str, fault: str) -> None:
        if self.last is None:
            self.first = initial
        elif self.last + initial not in _LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            if turn != self.highest:
                self.turns += 1
            self.lowest = turn if self.lowest is None else self.lowest
            self.highest = turn
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.symbols.append(symbol)


def _symbols(row: dict, copy: int) -> tuple[str, str]:
    """(symbol, fault) of the copy-th of equal rows of a turn."""
    if row["blank"]:
        return GONE, "blank"
    if row["seen"] or copy:
        return GONE, "duplicate"
    return (row["initial"].upper(), "truncated") if row["truncated"] else (row["initial"], "")


def _pieces(part: int, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces of the conversations of one sorted partition."""
    known: dict[str, Matrix] = {}
    done: list[tuple[object, int, _Piece]] = []
    current: _Piece | None = None
    key, number = None, 0

    def flush() -> pa.RecordBatch:
        texts = ["".join(p.symbols) for _, _, p in done]
        new = {t for t in texts if t not in known}
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(texts)
        known.update(matrices(new))
        rows = []
        for (conv, no, p), text in zip(done, texts):
            cells = known[text]
            rows.append(
                {
                    "conv_id": conv, "part": part, "piece": no, "first": p.first, "last": p.last, "lowest": p.lowest,
                    "highest": p.highest, "turns": p.turns, "blank": p.blank, "duplicate": p.duplicate,
                    "truncated": p.truncated, "illegal": p.illegal, "cost": [c and c[0] for c in cells],
                    "audit": [c and _flat(c[1]) for c in cells],
                }
            )
        done.clear()
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            if current is None or row["conv_id"] != key:
                if current is not None:
                    done.append((key, number, current))
                key, number, current = row["conv_id"], 0, _Piece([])
            for copy in range(row["n"]):
                if len(current.symbols) >= PIECE:
                    done.append((key, number, current))
                    number, current = number + 1, _Piece([])
                    if len(done) >= 1000:
                        yield flush()
                current.add(row["turn"], row["initial"], *_symbols(row, copy))
        if done:
            yield flush()
    if current is not None:
        done.append((key, number, current))
        yield flush()


# ---- pieces and texts to the result --------------------------------------------------------


class _Ways:
    """Cheapest way to every state so far; what all ways have in common is kept once."""

    def __init__(self) -> None:
        self.common: list[str] = []
        self.ways: list[Entry] = [(0, "") if q == START else None for q in range(STATES)]

    def add(self, cost: list[int | None], audit: list[str | None]) -> None:
        cells = [None if c is None else (c, a) for c, a in zip(cost, audit)]
        after: list[Entry] = []
        for q in range(STATES):
            best: Entry = None
            for p in range(STATES):
                way, cell = self.ways[p], cells[STATES * p + q]
                if way is not None and cell is not None:
                    best = _better(best, (way[0] + cell[0], way[1] + cell[1]))
            after.append(best)
        alive = [w[1] for w in after if w is not None]
        low, high = min(alive), max(alive)
        same = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), len(low))
        self.common.append(low[:same])
        self.ways = [w and (w[0], w[1][same:]) for w in after]

    def best(self) -> tuple[int, str]:
        self.add([c and c[0] for c in INSERTIONS], [c and _flat(c[1]) for c in INSERTIONS])
        found: Entry = None
        for q in ACCEPTED:
            found = _better(found, self.ways[q])
        return found[0], "".join(self.common) + found[1]


class _Conversation:
    """One conversation: pieces first, then its rows in order."""

    def __init__(self, conv_id) -> None:
        self.out = {"conv_id": conv_id, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.ways, self.last, self.lowest, self.highest, self.turns = _Ways(), None, None, None, 0
        self.digest, self.audit, self.at, self.odd, self.made = hashlib.sha256(), None, 0, 0, 0

    def piece(self, row: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            self.out[name] += row[name]
        if row["first"] is not None:
            if self.last is not None and self.last + row["first"] not in _LEGAL:
                self.out["illegal"] += 1
            self.last = row["last"]
        if row["lowest"] is not None:
            self.turns += row["turns"] - (row["lowest"] == self.highest)
            self.lowest = row["lowest"] if self.lowest is None else self.lowest
            self.highest = row["highest"]
        self.ways.add(row["cost"], row["audit"])

    def _settle(self) -> None:
        self.out["cost"], self.audit = self.ways.best()
        self.odd = (len(self.audit) - self.audit.count("D")) % 2

    def _line(self, role: str | None, text: str) -> None:
        """A repaired row; without a role it is a user's or an assistant's by its place."""
        role = ("assistant" if (self.made - self.odd) % 2 else "user") if role is None else role
        self.digest.update((("\n" if self.made else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.made += 1

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(None, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        if self.audit is None:
            self._settle()
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else None, text)

    def result(self) -> dict:
        if self.audit is None:
            self._settle()
        self._inserted()
        if self.lowest is not None:
            self.out["gaps"] = min(max(self.highest - self.lowest + 1 - self.turns, _LEAST), _MOST)
        return self.out | {"audit": self.audit, "repaired_sha256": self.digest.hexdigest()}


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces (``kind`` 0) and rows (``kind`` 1) of whole conversations, sorted, to one row per conversation."""
    current: _Conversation | None = None
    done: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if current is None or row["conv_id"] != current.out["conv_id"]:
                if current is not None:
                    done.append(current.result())
                current = _Conversation(row["conv_id"])
            if row["kind"] == 0:
                current.piece(row)
            else:
                current.row(row["role"], row["text"])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    if current is not None:
        yield pa.RecordBatch.from_pylist([current.result()], schema=schema)


def repair_conversations(rows: DataFrame, dropped: str | None = None) -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text, ...)``: its faults and the cheapest repair.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (initials of Keep, Rerole, Delete, Insert) and
    repaired_sha256 (of the repaired ``role:text`` lines). ``dropped`` names a boolean column of rows that are not
    there, whose conversations are reported all the same. A conversation is read by turn, null turns first; rows of
    one turn by a digest of role and text. Null roles and texts are one space, a null conv_id is a conversation of its
    own, a repeated row is a duplicate, other columns are ignored and an empty table gives no rows.
    """
    spark = rows.sparkSession
    gone = F.coalesce(F.col(dropped), F.lit(False)) if dropped else F.lit(False)
    space = F.lit(" ")
    cut = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"), gone.alias("gone"),
    )
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    texts = cut.withColumn("digest", F.when(~F.col("gone"), digest))
    body = _body(F.col("text"))
    slim = texts.select(
        "conv_id", F.when(~F.col("gone"), F.col("turn")).alias("turn"), "digest",
        F.when(~F.col("gone"), F.struct(
            _initial(F.col("role")).alias("initial"), (body == "").alias("blank"),
            (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        )).alias("of"),
    )
    path = scratch_path(spark, "conversation-rows")
    slim = slim.groupBy("conv_id", "turn", "digest").agg(F.any_value("of").alias("of"), F.count("digest").alias("n"))
    slim.write.parquet(path)
    slim = spark.read.parquet(path)
    # Contents of more than one turn; the first of them is no duplicate.
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = slim.where("digest is not null").groupBy("conv_id", "digest").agg(F.min(when).alias("first"), F.count("*").alias("c"))
    firsts = firsts.where("c > 1").select(F.col("conv_id").alias("conv"), F.col("digest").alias("d"), "first")
    marked = slim.join(firsts, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("digest") == F.col("d")), "left")
    marked = marked.select(
        "conv_id", "turn", "digest", "n", "of.*", F.coalesce(when > F.col("first"), F.lit(False)).alias("seen")
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    in_order = marked.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")
    in_order = in_order.withColumn("part", F.spark_partition_id())
    piece_schema = PIECES.format(id=kind)
    arrow = to_arrow_schema(StructType.fromDDL(piece_schema))

    def to_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            yield from _pieces(first.column("part")[0].as_py(), chain([first], batches), arrow)

    pieces = in_order.mapInArrow(to_pieces, piece_schema)
    present = texts.where(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text")
    both = pieces.withColumn("kind", F.lit(0)).unionByName(present, allowMissingColumns=True)
    gathered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "piece", "turn", "digest").drop("digest")
    result_schema = REPAIRED.format(id=kind)
    result_arrow = to_arrow_schema(StructType.fromDDL(result_schema))
    return gathered.mapInArrow(lambda batches: _repaired(batches, result_arrow), result_schema)


#: The kinds of damage, by crc32 of ``conv_id:turn`` modulo this.
DAMAGE_OF = 20


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: the table with rows dropped, emptied, cut, repeated and given to the user.

    Nulls count as one space, also in the key that picks the damage; a null turn stays null.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % DAMAGE_OF
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    out = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return out.drop("copy")
