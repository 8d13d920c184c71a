from __future__ import annotations

import hashlib
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txrisk.llm import near_dedup
from txrisk.llm.components import connected_components
from txrisk.llm.exact_dedup import ExtendibleHash, build_index, exact_groups, keep_one_of_equal
from txrisk.llm.near_dedup import NearDedup, keep_one_per_component, near_components
from txrisk.llm.suffix_dedup import RepeatedStrings, _stored, later_places, picked_runs, remove_repeats, repeated_starts, transform_of


def shingles(text, n):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute_components(rows, n, percent=80):
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return sorted(
        ((d, len(s), min(ids[find(i)], default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr
    )


@pytest.mark.parametrize("n", [2, 5])
def test_near_components_equal_brute_force(make_docs, odd_rows, n):
    got = near_components(make_docs(odd_rows), NearDedup(shingle_words=n)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(odd_rows, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_components_of_a_large_loose_group(make_docs, words):
    rng = np.random.default_rng(3)
    base = [words[i] for i in rng.integers(0, 400, 60)]
    rows = []
    for d in range(120):
        copy = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 7)):
            copy[at] = words[rng.integers(0, 400)]
        rows.append((d, " ".join(copy)))
    got = near_components(make_docs(rows), NearDedup(shingle_words=2)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows, 2)


@pytest.mark.parametrize("nodes", [1024, 40])
def test_near_components_of_a_loose_family_of_400(make_docs, words, monkeypatch, nodes):
    """Similarities all around the threshold, one big bucket after the other, cut into blocks or not: no link lost."""
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", nodes)
    rng = np.random.default_rng(31)
    base = [words[i] for i in rng.integers(0, 400, 80)]
    rows = []
    for d in range(400):
        copy = list(base)
        for at in rng.choice(80, rng.integers(2, 9), replace=False):
            copy[at] = words[rng.integers(0, 400)]
        rows.append((d, " ".join(copy)))
    got = near_components(make_docs(rows), NearDedup(shingle_words=2)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows, 2)


@pytest.mark.parametrize("size", [8, 60])
def test_links_of_two_blocks_are_a_spanning_forest(size):
    rng = np.random.default_rng(size)
    base = rng.choice(10**6, 50, replace=False)
    sets = []
    for _ in range(size):
        own = base.copy()
        own[rng.choice(50, rng.integers(0, 9), replace=False)] = rng.integers(10**6, 2 * 10**6)
        sets.append(np.unique(own).astype(np.int64))
    block, nodes = np.arange(size) % 2, [bytes([i]) for i in range(size)]
    for low, high in [(0, 0), (0, 1), (1, 1)]:
        want = {
            (i, j) for i in range(size) for j in range(size) if (block[i], block[j]) == (low, high) and i != j and (low != high or i < j)
            and 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))
        }
        got = [(u[0], v[0]) for u, v in near_dedup._forest_links(low, high, block, nodes, nodes, sets, 80)]
        assert set(got) <= want and len(got) < size

        def classes(links):
            forest = near_dedup._Forest()
            for a, b in links:
                forest.join(a, b)
            return [forest.root(i) for i in range(size)]

        a, b = classes(got), classes(want)
        assert all((a[i] == a[j]) == (b[i] == b[j]) for i in range(size) for j in range(size))


def test_near_keeps_one_row_per_group(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = keep_one_per_component(docs, NearDedup(shingle_words=5))
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(6) == 1 and 7 not in ids and ids.count(9) == 2 and {1, 2, 3, 4, 5} <= set(ids)


def test_near_keeps_one_row_of_groups_without_ids_of_their_own(make_docs, words):
    rng = np.random.default_rng(8)

    def family():
        base = [words[i] for i in rng.integers(0, 400, 200)]
        return [" ".join([*base[:at], f"changed{at}", *base[at:]]) for at in range(0, 200, 50)]

    unnamed, shared = family(), family()
    rows = [(None, t) for t in unnamed + unnamed[:2]] + [(3, t) for t in shared + shared[:1]]
    got = [(r.doc_id, r.text) for r in keep_one_per_component(make_docs(rows), NearDedup()).collect()]
    assert sorted(d or 0 for d, _ in got) == [0, 3] and all(row in rows for row in got)
    kept = {(r.doc_id, r.text_hash) for r in near_components(make_docs(rows), NearDedup()).collect() if r.kept}
    assert len(kept) == 2


def test_near_sets_are_read_once_per_node(spark, make_docs, words, monkeypatch):
    rng = np.random.default_rng(9)
    base = [words[i] for i in rng.integers(0, 400, 100)]
    rows = [(None, " ".join([*base[:at], f"changed{at}", *base[at:]])) for at in range(0, 100, 25)] * 3
    seen, sets_of = [], near_dedup._sets
    monkeypatch.setattr(near_dedup, "_sets", lambda texts, p: seen.append(texts.count()) or sets_of(texts, p))
    near_components(make_docs(rows), NearDedup())
    assert seen == [4]


@pytest.mark.parametrize("stage", [keep_one_per_component, keep_one_of_equal, near_components, exact_groups, remove_repeats])
def test_empty_tables(make_docs, stage):
    assert stage(make_docs([])).collect() == []


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, None), (2, 1)]
    got = dict(connected_components(spark.createDataFrame(links, "u int, v int")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


@pytest.mark.parametrize("capacity", [2, 1 << 18])
def test_exact_groups(make_docs, odd_rows, capacity):
    docs = make_docs(odd_rows)
    groups = defaultdict(list)
    for d, t in odd_rows:
        groups[t or ""].append(d)
    want = []
    for d, t in odd_rows:
        ids = groups[t or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    p = ExtendibleHash(capacity=capacity, first_depth=1)
    got = exact_groups(docs, p).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = keep_one_of_equal(docs, p)
    assert kept.columns == docs.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted(groups)


def test_buckets_split_to_capacity(make_docs, words):
    docs = make_docs([(i, w) for i, w in enumerate(sorted(set(words)))])
    index, cells, depth = build_index(docs, ExtendibleHash(capacity=10, first_depth=1))
    sizes = [r["count"] for r in index.groupBy("bucket").count().collect()]
    assert sum(sizes) == len(set(words)) and max(sizes) <= 10
    buckets = {r.bucket for r in cells.collect()}
    assert not any(a != b and b.startswith(a) for a in buckets for b in buckets)


def brute_repeats(rows, width):
    seen, covered = set(), []
    for raw in rows:
        c = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            if w in seen:
                c[i : i + width] = b"\1" * width
            seen.add(w)
        covered.append(bytes(c))
    return covered


@pytest.mark.parametrize("p", [RepeatedStrings(), RepeatedStrings(hot=2, portion=8, shard=3)])
def test_removed_bytes_equal_brute_force(make_docs, odd_rows, p):
    rows = sorted({(d, t) for d, t in odd_rows if d is not None and d != 9 and d < 10 or d in (12, 13)}, key=lambda r: r[0])
    part = odd_rows[5][1][50:400]
    rows += [(20, "before " + part + " after"), (21, part[:130] + part[200:]), (22, part[:99]), (23, part[:100])]
    raw = [(t or "").encode() for _, t in rows]
    got = {r.doc_id: r for r in remove_repeats(make_docs(rows), p).collect()}
    for (d, _), x, c in zip(rows, raw, brute_repeats(raw, 100)):
        kept = bytes(b for b, gone in zip(x, c) if not gone)
        spans = len([s for s in c.split(b"\0") if s])
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, bytes(got[d].kept)) == (len(x), sum(c), spans, kept), d
        assert got[d].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_repeats_with_odd_rows(make_docs, odd_rows):
    got = remove_repeats(make_docs(odd_rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(d), len((t or "").encode())) for d, t in odd_rows)
    assert all(r.n_removed == r.n_bytes for r in got if r.doc_id is None and r.n_bytes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=12), st.sampled_from([2, 4, 7]), st.sampled_from([1, 3, 50]))
def test_intervals_of_merged_transforms(strings, width, shard):
    string, start, interval = repeated_starts(strings, width, shard)
    got = defaultdict(set)
    for s, b, i in zip(string.tolist(), start.tolist(), interval.tolist()):
        got[i].add((s, b))
    want = defaultdict(set)
    for s, x in enumerate(strings):
        for b in range(len(x) - width + 1):
            want[x[b : b + width]].add((s, b))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_transform_steps_and_symbols():
    strings = [b"banana", b"", b"bandana"]
    t = transform_of(strings, 20)
    joined = b"\0".join(strings) + b"\0"
    suffixes = [joined[at : joined.index(b"\0", at)] for at in t.place]
    assert suffixes == sorted(suffixes)
    for row, at in enumerate(t.place):
        assert t.row_of[at] == row and t.place[t.step[row]] == (at - 1) % len(joined)
        starts = at == 0 or joined[at - 1] == 0
        assert t.symbol[row] == (0 if starts else joined[at - 1] + 1)


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=40, max_size=160).map(lambda b: bytes(x % 4 for x in b)))
def test_every_window_picks_a_run_by_its_content_only(data):
    p = RepeatedStrings(width=12, anchor=4)
    places, _, low, high = picked_runs(np.frombuffer(data, dtype=np.uint8), p)
    windows = {}
    for at, first, last in zip(places.tolist(), low.tolist(), high.tolist()):
        assert at - 8 <= first <= last <= at
        for b in range(first, last + 1):
            windows.setdefault(b, set()).add(at - b)
    assert sorted(windows) == list(range(len(data) - 11))
    by_content = {}
    for b, picked in windows.items():
        own = picked_runs(np.frombuffer(data[b : b + 12], dtype=np.uint8), p)[0]
        assert picked == set(own.tolist())
        assert by_content.setdefault(data[b : b + 12], picked) == picked


@pytest.mark.parametrize("width", [7, 8])
@pytest.mark.parametrize("values", [3, 256])
def test_rounds_of_two_symbols_reach_any_width(width, values):
    """All 256 bytes and the end mark are too many for pairs; an even width leaves an odd number of rounds."""
    rng = random.Random(width)
    every = [bytes(range(256))] if values == 256 else []
    strings = every + [bytes(rng.randrange(values) for _ in range(60)) for _ in range(30)]
    strings += [b"head" + s[5:40] for s in strings]
    want = defaultdict(set)
    for s, x in enumerate(strings):
        for b in range(len(x) - width + 1):
            want[x[b : b + width]].add((s, b))
    got = defaultdict(set)
    for s, b, i in zip(*(x.tolist() for x in repeated_starts(strings, width, 16))):
        got[i].add((s, b))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_later_places_leave_out_the_first_of_each_interval():
    place = np.array([5, 9, 5, 7, 2, 8, 5])
    interval = np.array([0, 0, 1, 1, 2, 2, 2])
    assert later_places(place, interval).tolist() == [5, 7, 8, 9]
    assert later_places(place[:0], interval[:0]).tolist() == []


def test_stored_tables_keep_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        return {f.toString() for f in map(files.apply, range(files.size())) if "shuffle_" in f.getName()}

    spark.sparkContext._jvm.System.gc()
    before = shuffled()
    stored = _stored(spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 90).alias("k")).count(), "test")
    for _ in range(50):
        left = shuffled() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and stored.count() == 90
