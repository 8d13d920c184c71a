from __future__ import annotations

import math
import random
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from txrisk.llm.decontamination import contained_items, drop_contaminated
from txrisk.llm.license_scan import TEMPLATES, scan_licenses
from txrisk.llm.line_dedup import LineTree, drop_recurring_lines
from txrisk.llm.packing import WordIds, binary_pieces, pack, word_ids
from txrisk.llm.quality_rules import RuleEnsemble, STATISTICS, fit_rules, held_out, keep_good, score_quality, text_statistics
from txrisk.llm.token_counts import count_tokens
from txrisk.llm.url_filter import Rule, fit_url_model, judge_urls

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = "abZ' st 12.,!\n\té\u0130Σ…\u0301\u3000<|>\x1c\x00ßﬁ▁$&é"


def odd_texts(n, seed):
    rng = random.Random(seed)
    alphabet = [*ODD, "<|endoftext|>", "<|ENDOFTEXT|>", "'re", " don't ", "  ", "<s>", "word"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_token_counts_equal_the_library(make_docs, odd_rows):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    rows = [(d, t) for d, t in odd_rows if d is not None and d not in (6, 9)] + list(enumerate(odd_texts(1500, 1), 100))
    got = {r.doc_id: r for r in count_tokens(make_docs(rows), PIECES).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        n = len(model.encode(t or ""))
        assert (got[d].n_tokens, got[d].n_bytes, got[d].over_limit) == (n, len((t or "").encode()), n > 4096), repr(t)


def test_token_counts_of_rows_without_or_with_repeated_ids(make_docs):
    got = count_tokens(make_docs([(None, "some words"), (1, "some words"), (1, "some words"), (1, ""), (None, None)]), PIECES)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == [("1", 0), ("1", 2), ("1", 2), ("None", 0), ("None", 2)]
    assert count_tokens(make_docs([]), PIECES).collect() == []


def test_word_ids_equal_the_library(odd_rows):
    from tokenizers import Tokenizer

    library, words = Tokenizer.from_file(WORDS), WordIds(WORDS)
    texts = [t or "" for _, t in odd_rows] + odd_texts(4000, 2)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for text, raw in zip(part, words.encode_batch(part, 1)):
            want = [*library.encode(text, add_special_tokens=False).ids, 1]
            assert raw == b"".join(i.to_bytes(4, "little") for i in want), repr(text)


def test_plain_words_do_without_the_whole_tokenizer_and_are_kept(monkeypatch):
    from tokenizers import Tokenizer

    library, words = Tokenizer.from_file(WORDS), word_ids(WORDS)
    latin = [chr(i) for i in range(33, 256) if chr(i).isalpha() or i < 127 and chr(i) != "'"]
    rng = random.Random(3)
    texts = ["".join(latin), *("".join(rng.choices(latin, k=rng.randint(1, 12))) for _ in range(3000))]
    texts = [t for t in texts if "<|" not in t]
    whole = words._library_ids
    monkeypatch.setattr(words, "_library_ids", lambda text: pytest.fail(f"{text!r} goes through the whole tokenizer"))
    for text, raw in zip(texts, words.encode_batch(texts, 1)):
        want = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert raw == b"".join(i.to_bytes(4, "little") for i in want), repr(text)
    monkeypatch.setattr(words, "_library_ids", whole)
    assert word_ids(WORDS) is words and b"word" in (words if words.encode_batch(["word"], 1) else ())


def test_words_survive_one_change_of_generations(monkeypatch):
    monkeypatch.setattr("txrisk.llm.packing.CACHE_WORDS", 3)
    words = WordIds(WORDS)
    texts = ["one two three four", "one <|endoftext|>X it's", "five one", "Größe ² 漢字", ""]
    assert [words.encode_batch([t], 1) for t in texts * 3] == [WordIds(WORDS).encode_batch([t], 1) for t in texts * 3]


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000])
def test_binary_pieces(n):
    pieces = list(binary_pieces(n, 2048))
    assert [s for s, _ in pieces] == [sum(length for _, length in pieces[:i]) for i in range(len(pieces))]
    assert sum(length for _, length in pieces) == n and all(length & (length - 1) == 0 and length <= 2048 for _, length in pieces)


def test_packing_is_a_round_trip(make_docs, odd_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rows = [(i, t) for i, (_, t) in enumerate(odd_rows)]
    got = pack(make_docs(rows), WORDS).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and 1 << r.bucket == r.length for r in got)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for d, t in rows:
        raw = b"".join(i.to_bytes(4, "little") for i in [*library.encode(t or "", add_special_tokens=False).ids, 1])
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(raw) // 4
            assert r.ids_crc32 == zlib.crc32(raw[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(raw) // 4
    assert pack(make_docs([]), WORDS).collect() == []


def test_packing_of_rows_without_or_with_repeated_ids(make_docs):
    got = pack(make_docs([(None, "a"), (1, "a b c"), (1, "a b c"), (1, "d")]), WORDS).collect()
    assert len({r.sequence_id for r in got}) == len(got) == 1 + 1 + 1 + 1


def test_licences(make_docs):
    apache = TEMPLATES[0][1]
    rows = [
        (1, f"some text before the notice\n{apache}\nand more of it after"),
        (2, apache.upper().replace(",", " ")),
        (3, None),
        (4, ""),
        (5, "Licensed under the Apache"),
        (6, f"{apache}\n{apache}"),
        (None, apache),
        (7, "word " * 50_000),
        (8, "Released under the MIT License now."),
    ]
    got = {(r.doc_id, r.licence): (round(r.dice, 3), r.n_units) for r in scan_licenses(make_docs(rows)).collect()}
    assert got == {
        (1, "Apache-2.0"): (1.0, 1),
        (2, "Apache-2.0"): (1.0, 1),
        (6, "Apache-2.0"): (1.0, 3),
        (None, "Apache-2.0"): (1.0, 1),
        (8, "MIT"): (0.889, 1),
    }
    assert scan_licenses(make_docs([])).collect() == []
    assert scan_licenses(make_docs(rows), templates=[]).collect() == []


def test_recurring_templates_go(make_docs, words):
    rng = random.Random(9)

    def prose():
        return " ".join(rng.choice(words) for _ in range(12))

    rows = [(d, f"{prose()}\nuser {rng.choice(words)}{d} logged in from host {d}.{d} today\n\n{prose()}") for d in range(6)]
    rows += [(10, None), (11, ""), (12, "only this line here"), (13, "x " * 40_000), (None, "user a1 logged in from host 3 today")]
    rows += [(14, "visit the page of Smith for all details"), (15, "visit the page of Jones for all details"), (16, "visit the page of Brown for all details")]
    rows += [(17, "twice in one\ntwice in one\ntwice in one"), (17, "twice in one\ntwice in one\ntwice in one")]
    got = drop_recurring_lines(make_docs(rows), LineTree()).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert (r.text, r.n_dropped) == ("", 1)
        elif r.doc_id < 6:
            source = rows[r.doc_id][1].split("\n")
            assert (r.text, r.n_lines, r.n_dropped) == ("\n".join([source[0], source[2], source[3]]), 4, 1)
        elif r.doc_id in (14, 15, 16):
            assert (r.text, r.n_dropped) == ("", 1)
        else:
            source = next(t for d, t in rows if d == r.doc_id) or ""
            assert (r.text, r.n_dropped) == (source, 0)
    assert drop_recurring_lines(make_docs([])).collect() == []


def test_a_leaf_holds_many_groups(make_docs, words):
    """Three footers in one leaf with the same names in them, among unrelated lines of the leaf."""
    rng = random.Random(4)
    names = ["Smith", "Jones", "Brown", "Miller", "Garcia", "Davis", "Wilson", "Moore"]
    feet = ["sent by our mailing partner {} today", "sent by our customer service {} team", "sent by our billing office {} now"]
    rows = [(i, foot.format(name)) for i, (foot, name) in enumerate((f, n) for f in feet for n in names)]
    rows += [(100 + i, "sent by our " + " ".join(rng.sample(words, 4))) for i in range(60)]
    got = {r.doc_id: r.n_dropped for r in drop_recurring_lines(make_docs(rows)).collect()}
    assert all(got[i] == 1 for i in range(24))
    assert sum(got[100 + i] for i in range(60)) <= 2
    # Fuller leaves lose nothing.
    more = rows + [(1000 + i, "sent by our " + " ".join(rng.sample(words, 4))) for i in range(300)]
    again = {r.doc_id: r.n_dropped for r in drop_recurring_lines(make_docs(more)).collect()}
    assert all(again[i] == 1 for i in range(24))


def _runs(text, n=None):
    """The runs of ``n`` words; of an item, its own: five words, or all of a shorter one."""
    w = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    n = min(5, len(w)) if n is None else n
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} - {()}


def test_contained_items_equal_brute_force(spark, make_docs, odd_rows, words):
    rng = random.Random(4)
    item = [rng.choice(words) for _ in range(40)]
    edited = [*item[:30], "other", *item[31:]]
    items = [(1, " ".join(item)), (2, None), (3, ""), (4, "one two"), (5, odd_rows[5][1][:200]), (5, "another text under this id today"), (1, " ".join(item))]
    # Items of one to four words, inside long documents.
    short = [(60 + n, " ".join(item[:n])) for n in range(1, 5)] + [(70, "café"), (71, "no such words")]
    items += short
    benchmark = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, shingle string, doc_id int")
    rows = odd_rows + [
        (30, " ".join(item).upper() + "."),
        (31, odd_rows[13][1] + " " + ", ".join(edited) + " " + odd_rows[13][1]),
        (32, " ".join(item[:20]) + " filler words in the middle " + " ".join(item[20:])),
        (33, " ".join(item[:28])),
    ]
    docs = make_docs(rows)
    want = set()
    for d, t in rows:
        for i, x in items:
            q = _runs(x)
            own = _runs(t, len(next(iter(q)))) if q else set()
            if q and 100 * len(own & q) >= 80 * len(q):
                want.add((d, i, len(own & q), len(q)))
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in contained_items(docs, benchmark).collect()}
    assert got == want and {30, 31, 32} <= {d for d, i, _, _ in got if i == 1}
    assert {30, 31, 32, 33} <= {d for d, i, _, _ in got if i == 64} and 12 in {d for d, i, _, _ in got if i == 70}
    kept = drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    dirty = {d for d, _, _, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t in rows if d not in dirty or (d is None and t is None))
    assert contained_items(docs, benchmark.limit(0)).collect() == [] and contained_items(make_docs([]), benchmark).collect() == []


@pytest.fixture(scope="module")
def graded(make_docs, spark, words):
    rng = random.Random(8)
    rows, labels = [], []
    for d in range(240):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 60)))
        bad = d % 4 == 0
        rows.append((d, " ".join(w + "%%%" for w in text.split()) if bad else text))
        labels.append((d, int(not bad), 0))
    return make_docs(rows), spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")


def test_rules_score_held_out_rows(graded):
    docs, labels = graded
    model = fit_rules(docs, labels, RuleEnsemble(trees=5))
    assert model.rules and all(rule.weight for rule in model.rules)
    got = score_quality(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == int(r.doc_id % 4 != 0) and 0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in keep_good(docs, model).collect()} == {d for d in range(240) if d % 4}
    # The compiled expression is the weighted sum of the rules that hold.
    row = docs.where("doc_id = 4").first()
    stats = text_statistics(row.text)
    logit = model.intercept + sum(r.weight for r in model.rules if all((stats[at] > b) == above for at, above, b in r.bounds))
    assert math.isclose(next(r.score for r in got if r.doc_id == 4), 1 / (1 + math.exp(-logit)), rel_tol=1e-9)


def test_labels_of_held_out_rows_are_not_learned(graded):
    docs, labels = graded
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    p = RuleEnsemble(trees=3)
    assert fit_rules(docs, labels, p) == fit_rules(docs, turned, p)


def test_scores_of_odd_rows(graded, make_docs, odd_rows):
    docs, labels = graded
    model = fit_rules(docs, labels, RuleEnsemble(trees=2))
    got = score_quality(make_docs(odd_rows), model).collect()
    assert len(got) == len(odd_rows) and all(r.score is not None and r.held_out is not None for r in got)
    assert score_quality(make_docs([]), model).collect() == []
    assert fit_rules(docs, labels.limit(0)).score(F.struct(*(F.lit(0.0).alias(s) for s in STATISTICS))) is not None
    assert [r.score for r in score_quality(make_docs([(1, "x")]), fit_rules(docs, labels.limit(0))).collect()] == [0.5]
    only = fit_rules(docs, labels.where("quality = 1"))
    assert [r.predicted for r in score_quality(make_docs([(1, "x"), (2, None)]), only).collect()] == [1, 1]


RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
]


def test_urls(spark):
    urls = [
        ("http://example.com/en/x", "example.com", "/en/x", "example.com/en/", "block"),
        ("https://WWW.Example.com/en/1?q=/es/", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        ("http://a.net/es/1#x", "a.net", "/es/1", "net/es/", "block"),
        ("http://a.net?/es/", "a.net", "", None, None),
        ("http://a.com", "a.com", "", None, None),
        ("x://y://z/w", "y:", "//z/w", None, None),
        ("no scheme", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
        ("http://a.org/" + "p" * 20_000, "a.org", "/" + "p" * 20_000, None, None),
    ]
    pages = spark.createDataFrame([(i, u[0], "h", 1.0) for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string, score double")
    labelled = spark.createDataFrame(
        [(f"http://good{i}.org/a/{i}", "allow") for i in range(60)] + [(f"http://spam{i}.org/casino/{i}", "block") for i in range(60)] + [(None, "allow"), ("http://x.org", None)],
        "url string, verdict string",
    )
    model = fit_url_model(labelled)
    got = {r.page_id: r for r in judge_urls(pages, RULES, model).collect()}
    assert len(got) == len(urls) + 1
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), i
        assert got[i].verdict == (verdict or ("block" if got[i].score >= 0.5 else "allow"))
    new = spark.createDataFrame([(1, "http://good999.org/a/77"), (2, "http://spam999.org/casino/3")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge_urls(new, [], model).collect()} == {1: "allow", 2: "block"}
    assert judge_urls(pages.limit(0), RULES, model).collect() == []
    assert fit_url_model(labelled.limit(0)) == "allow" and fit_url_model(labelled.where("verdict = 'block'")) == "block"


def test_labelled_urls_train_a_filter(spark):
    from pyspark.sql import functions as F

    from txrisk.llm.url_labels import labelled_urls

    table = labelled_urls(spark)
    by_domain = table.groupBy(F.regexp_extract("url", r"\.([a-z]+)/", 1).alias("d")).agg(F.countDistinct("verdict").alias("n")).collect()
    assert len(by_domain) == 6 and all(r.n == 2 for r in by_domain)
    held = F.crc32(F.col("url").cast("binary")) % 5 == 0
    model = fit_url_model(table.where(~held))
    pages = table.where(held).select(F.col("verdict").alias("page_id"), "url")
    judged = judge_urls(pages, [], model)
    assert judged.where("page_id != verdict").count() <= 0.02 * judged.count()
    # Sites that are not in the table, under the same domains.
    new = spark.createDataFrame([(1, "http://ads-track.example.org/en/1"), (2, "https://blog.other.example.org/en/1"), (3, "http://xxx-pills.example.net/fr/5"), (4, "https://www.library-north.example.net/fr/5")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge_urls(new, [], model).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}


def test_many_rules_are_joined(spark, monkeypatch):
    from txrisk.llm import url_filter

    urls = ["http://a.b.com/x/y", "http://b.com/x", "http://b.com/", "http://com/", "http://xb.com/x", None, "no scheme", "http://b.com/x", "http://a..com/x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = [Rule("com", "/", "allow"), Rule("b.com", "/x", "block"), Rule("a.b.com", "/x/", "allow"), Rule("", "/", "block"), Rule("b.com", "/x", "block")]
    one = sorted(map(tuple, judge_urls(pages, rules, "allow").collect()), key=repr)
    monkeypatch.setattr(url_filter, "MAX_RULES", 2)
    assert sorted(map(tuple, judge_urls(pages, rules, "allow").collect()), key=repr) == one
