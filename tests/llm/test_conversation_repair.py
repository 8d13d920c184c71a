"""Repair against a plain shortest path per conversation, and against SQL's reading of the faults."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from txrisk.llm import conversation_repair as cr
from txrisk.llm.queries import op13
from txrisk.plans.registry import QUERIES

SPACE = "\x20\x09-\x0d"
STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """(cost, audit) by Dijkstra over (rows read, state); ``rows`` are (initial, must go, truncated)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit
        if (at, state) in seen:
            continue
        seen.add((at, state))
        for role in "ua":
            if role in STEP[state]:
                heapq.heappush(heap, (cost + 5, audit + "I", at, STEP[state][role]))
        if at < len(rows):
            initial, must_go, truncated = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state))
            if not must_go:
                extra = 5 if truncated else 0
                if initial in STEP[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, STEP[state][initial]))
                for role in "ua":
                    if role in STEP[state]:
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", at + 1, STEP[state][role]))


def brute(table):
    """The contract, row by row; ``table`` is (conv_id, turn, role, text)."""
    conversations = {}
    for conv, turn, role, text in table:
        rows = conversations.setdefault(conv, [])
        name = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in conversations.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, kinds, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            body = re.sub(f"[{SPACE}]+\\Z", "", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = cheapest(kinds)
        odd, lines, at = (len(audit) - audit.count("D")) % 2, [], 0
        for edit in audit:
            made = ("assistant" if (len(lines) - odd) % 2 else "user")
            if edit == "I":
                lines.append(f"{made}:")
                continue
            if edit != "D":
                lines.append(f"{rows[at][1] if edit == 'K' else made}:{rows[at][2]}")
            at += 1
        initials = "".join(line[:1] for line in lines)
        assert re.fullmatch("(s?(ua)+)?", initials)
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        firsts = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.select("conv_id", *names).collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def repaired(rows):
    return cr.repair_conversations(cr.damage(rows), dropped="dropped")


TABLE = "conv_id long, turn long, role string, text string, part long, kind string, n string, `first` long"


def frame(spark, table):
    return spark.createDataFrame([(*r, 1, "x", "x", 1) for r in table], TABLE)


def test_whole_table_equals_brute_force(spark):
    from paths import SF_DIR

    rows = spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got(op13(spark, SF_DIR)) == brute([tuple(r) for r in rows])


def test_query_is_registered():
    assert "op13_conversation_repair" in QUERIES


def random_table(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Fine.", "Cut off", "  \t\n", "", "Why?  \n", "Same.", None, "x" * 5000 + "!", "tail.\x0b", "é!"]
    roles = ["system", "user", "assistant", "tool", "", None, "u", "S"]
    out = []
    for conv in range(conversations):
        for _ in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.1 else rng.randint(0, longest)
            text = rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}."
            out.append((conv if conv else None, turn, rng.choice(roles if rng.random() < 0.3 else roles[:3]), text))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_odd_conversations_equal_brute_force(spark, seed):
    table = random_table(seed, 60, 14)
    assert got(repaired(frame(spark, table))) == brute(table)


def test_long_conversations_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(cr, "PIECE", 7)
    table = random_table(5, 4, 300)
    assert got(repaired(frame(spark, table).repartition(5))) == brute(table)


def test_many_equal_rows(spark):
    table = [(1, 2, "user", "Hello.")] * 700 + [(1, 3, "assistant", "Hello back.")] + [(2, None, None, None)] * 300
    assert got(repaired(frame(spark, table))) == brute(table)


def test_conversation_without_rows_left(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(repaired(frame(spark, [(gone, 0, "user", "Hi.")]))) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}


def test_empty_table(spark):
    assert repaired(frame(spark, [])).collect() == []


def test_rules_expand_to_the_sequences():
    rng = random.Random(3)
    sequences = ["".join(rng.choice("uaS-") for _ in range(rng.randint(0, 40))) for _ in range(50)]
    coded, rules = cr.re_pair(sequences)

    def expand(symbol):
        base = len(cr.SYMBOLS)
        return cr.SYMBOLS[symbol] if symbol < base else "".join(map(expand, rules[symbol - base]))

    assert ["".join(map(expand, s)) for s in coded] == sequences and rules
    assert sum(map(len, coded)) < sum(map(len, sequences))


def test_rule_matrices_are_the_products_of_their_rows():
    for text, matrix in cr.matrices(["uaua", "suau-a", "UaXx", "uaua-UaXxuaua"]).items():
        plain = cr.ROW_MATRICES[text[0]]
        for symbol in text[1:]:
            plain = cr.product(plain, cr.ROW_MATRICES[symbol])
        flat = [[c and (c[0], cr._flat(c[1])) for c in m] for m in (matrix, plain)]
        assert flat[0] == flat[1]
