"""The numbered queries: each applies its operator to a whole table and derives the result columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.conversation_repair import damage, repair_conversations
from txrisk.llm.decontamination import contained_items
from txrisk.llm.exact_dedup import exact_groups
from txrisk.llm.hard_negatives import mine_negatives, usable_rows
from txrisk.llm.license_scan import TEMPLATES, scan_licenses
from txrisk.llm.line_dedup import drop_recurring_lines
from txrisk.llm.near_dedup import NearDedup, near_components
from txrisk.llm.packing import pack
from txrisk.llm.quality_rules import fit_rules, score_quality
from txrisk.llm.suffix_dedup import remove_repeats
from txrisk.llm.token_counts import count_tokens
from txrisk.llm.toxicity import fit_toxicity, score_toxicity
from txrisk.llm.url_filter import Rule, fit_url_model, judge_urls
from txrisk.llm.url_labels import labelled_urls
from txrisk.plans.registry import query


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Host, path, verdict.
URL_RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


@query("op1_url_filter")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the package's own labelled urls; no label comes from a rule or from the pages."""
    return judge_urls(_read(spark, sf_dir, "pages"), URL_RULES, fit_url_model(labelled_urls(spark)))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"

OP2_SQL = f"""
WITH notices(template, licence, notice) AS (
    VALUES {", ".join(f"({i}, {_quoted(licence)}, {_quoted(text)})" for i, (licence, text) in enumerate(TEMPLATES))}
), units AS (
    SELECT doc_id, unnest(CASE WHEN contains(coalesce(text, ''), chr(10))
        THEN list_concat([text], string_split(text, chr(10))) ELSE [coalesce(text, '')] END) AS unit FROM documents
), words AS (
    SELECT doc_id, CAST(NULL AS INTEGER) AS template, NULL AS licence, {_WORDS.format("unit")} AS w FROM units
    UNION ALL SELECT NULL, template, licence, {_WORDS.format("notice")} FROM notices
), grams AS (
    SELECT doc_id, template, licence, CASE WHEN len(w) < 2 THEN w ELSE
        list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM words
), pairs AS (
    SELECT u.doc_id, t.licence, len(list_intersect(u.g, t.g)) AS shared, len(u.g) + len(t.g) AS both_sizes
    FROM grams u JOIN grams t ON u.template IS NULL AND t.template IS NOT NULL
    WHERE len(u.g) > 0 AND len(u.g) <= 2 * len(t.g) AND len(t.g) <= 2 * len(u.g)
)
SELECT doc_id, licence, max(2.0::DOUBLE * shared / both_sizes) AS dice, count(*) AS n_units
FROM pairs WHERE shared * 200 >= both_sizes * 80 GROUP BY ALL
"""


@query("op2_license_scan", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
    SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line_no, unnest(lines) AS line FROM docs
), cut AS (
    SELECT doc_id, line_no, list_transform(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''),
        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM numbered
), lines AS (
    SELECT *, concat_ws(' ', len(t), t[1], t[2], t[3]) AS leaf FROM cut WHERE len(t) >= 3
), crowded AS (
    SELECT leaf FROM lines GROUP BY leaf HAVING count(DISTINCT doc_id) > 1 AND count(DISTINCT t) > 1
), members AS (
    SELECT DISTINCT leaf, t FROM lines JOIN crowded USING (leaf)
), tokens AS (
    SELECT leaf, t, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS token FROM members
), weighed AS (
    SELECT leaf, t, pos, token, count(*) OVER (PARTITION BY leaf, pos, token) AS n FROM tokens WHERE token <> '<*>'
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY leaf, t ORDER BY n DESC, pos) AS rank, count(*) OVER (PARTITION BY leaf, t) AS fixed,
        (len(t) * 60 + 99) // 100 AS wanted FROM weighed
), general AS (
    SELECT leaf, t, list_concat([len(t)::VARCHAR], list(pos::VARCHAR || ' ' || token ORDER BY pos)) AS g
    FROM ranked WHERE fixed >= wanted AND rank <= wanted GROUP BY leaf, t
), templates AS (
    SELECT doc_id, line_no, coalesce(g, list_concat([''], l.t)) AS template
    FROM lines l LEFT JOIN general g ON g.leaf = l.leaf AND g.t = l.t
), recurring AS (
    SELECT template FROM templates GROUP BY template HAVING count(DISTINCT doc_id) >= 3
), dropped AS (
    SELECT doc_id, line_no FROM templates JOIN recurring USING (template)
)
SELECT doc_id, coalesce(string_agg(n.line, chr(10) ORDER BY n.line_no) FILTER (WHERE d.line_no IS NULL), '') AS text,
    count(*) AS n_lines, count(d.line_no) AS n_dropped
FROM numbered n LEFT JOIN dropped d USING (doc_id, line_no) GROUP BY doc_id
"""


@query("op3_line_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(_read(spark, sf_dir, "documents"))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OP7_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
    FROM words
), classes AS (
    SELECT list_sort(s) AS s, min(doc_id) AS cls, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)
), grams AS (
    SELECT cls, n, unnest(s) AS g FROM classes
), counted AS (
    SELECT cls, n, g, count(*) OVER (PARTITION BY g) AS f FROM grams
), prefixes AS (
    SELECT cls, n, g FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY f, g) AS r FROM counted)
    WHERE r <= n - (n * 8 + 9) // 10 + 1
), pairs AS (
    SELECT DISTINCT a.cls AS a, b.cls AS b FROM prefixes a JOIN prefixes b ON a.g = b.g AND a.cls < b.cls
    AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
), links AS (
    SELECT a, b FROM (
        SELECT p.a, p.b, len(list_intersect(x.s, y.s)) AS i, x.n + y.n AS t
        FROM pairs p JOIN classes x ON x.cls = p.a JOIN classes y ON y.cls = p.b)
    WHERE 100 * i >= 80 * (t - i)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT cls AS a, cls AS b FROM classes
    UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b
), labels AS (
    SELECT a AS cls, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id,
    d.doc_id = coalesce(l.component_id, d.doc_id) AS kept
FROM sets d LEFT JOIN classes c ON len(d.s) > 0 AND list_sort(d.s) = c.s LEFT JOIN labels l ON l.cls = c.cls
"""


@query("op7_minhash_near_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_read(spark, sf_dir, "documents"), NearDedup(shingle_words=2)).drop("text_hash")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
    sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op8_exact_dedup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_read(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH words AS (
    SELECT doc_id, CAST(NULL AS BIGINT) AS item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
    UNION ALL SELECT NULL, item_id, {_WORDS.format("coalesce(text, '')")} FROM benchmark
), sets AS (
    SELECT item_id, least(len(w), 5) AS run, list_distinct(list_transform(range(1, len(w) - least(len(w), 5) + 2),
        lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s FROM words WHERE item_id IS NOT NULL AND len(w) > 0
), items AS (
    SELECT item_id, len(s) AS n_item, unnest(s) AS g FROM sets
), runs AS (
    SELECT DISTINCT run FROM sets
), docs AS (
    SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - run + 2), lambda i: array_to_string(w[i:i + run - 1], ' ')))) AS g
    FROM words, runs WHERE item_id IS NULL AND len(w) >= run
)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*)::DOUBLE / n_item AS containment
FROM docs JOIN items USING (g) GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 80
"""


@query("op9_benchmark_decontamination", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return score_quality(documents, fit_rules(documents, _read(spark, sf_dir, "labels")))


OP11_SQL = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_dot_product(a.v::DOUBLE[], r.v::DOUBLE[]) AS BIGINT) AS score
    FROM rows a JOIN rows r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""


@query("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = usable_rows(_read(spark, sf_dir, "embeddings").withColumn("label", label))
    return mine_negatives(rows, F.col("id") % 100 == 0)


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return score_toxicity(documents, fit_toxicity(documents, _read(spark, sf_dir, "labels")))


def _op13_sql() -> str:
    """A shortest path per conversation, a row at a time: the cheapest way to each of four states, then its edits applied."""

    def add(state: str, cost: str, edit: str) -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 's': {state}.s || {edit}}} END"

    def least(*ways: str) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"

    def opened(table: str) -> str:
        """Insertions before what follows: a user's row from any state but u, an assistant's after it."""
        two = f"SELECT *, {least('q2', add('q0', '5', chr(39) + 'I' + chr(39)), add('q1', '5', chr(39) + 'I' + chr(39)), add('q3', '5', chr(39) + 'I' + chr(39)))} AS e2 FROM {table}"
        return f"SELECT *, {least('q3', add('e2', '5', chr(39) + 'I' + chr(39)))} AS e3 FROM ({two})"

    drop, extra = ("2", "'D'"), "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    stays = "fault NOT IN ('blank', 'duplicate')"

    def to(state: str, role: str) -> str:
        cost = f"CASE WHEN initial = '{role}' THEN 0 ELSE 1 END + {extra}"
        return f"CASE WHEN {stays} THEN {add(state, cost, f'CASE WHEN initial = {chr(39)}{role}{chr(39)} THEN {chr(39)}K{chr(39)} ELSE {chr(39)}R{chr(39)} END')} END"

    system = f"CASE WHEN {stays} AND initial = 's' THEN {add('q0', extra, chr(39) + 'K' + chr(39))} END"
    step = f"""SELECT g, rn + 1 AS rn, {add('q0', *drop)} AS q0, {least(add('q1', *drop), system)} AS q1,
        {least(add('e2', *drop), to('q0', 'u'), to('q1', 'u'), to('e3', 'u'))} AS q2, {least(add('e3', *drop), to('e2', 'a'))} AS q3"""
    crc = """list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ord(substr(k, i, 1))::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""
    return f"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k,
        dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g FROM conversations
), kinds AS (
    SELECT *, xor({crc}, 4294967295) % 20 AS kind FROM keyed
), damaged AS (
    SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM kinds WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text)) AS rn,
        regexp_replace(text, '[\\x20\\x09-\\x0D]+\\z', '') AS body, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial FROM damaged
), marked AS (
    SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY rn) > 1 AS seen, lag(initial) OVER (PARTITION BY g ORDER BY rn) AS before FROM placed
), faults AS (
    SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM marked
), counts AS (
    SELECT g, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM faults GROUP BY g
), every AS (
    SELECT DISTINCT g, conv_id FROM keyed
), way(g, rn, q0, q1, q2, q3) AS (
    SELECT g, 0::BIGINT, {{'c': 0::BIGINT, 's': ''}}, NULL::STRUCT(c BIGINT, s VARCHAR), NULL::STRUCT(c BIGINT, s VARCHAR), NULL::STRUCT(c BIGINT, s VARCHAR) FROM every
    UNION ALL
    {step} FROM (SELECT w.*, f.initial, f.fault FROM ({opened('way')}) w JOIN faults f ON f.g = w.g AND f.rn = w.rn + 1)
), best AS (
    SELECT w.g, {least('q0', 'e3')} AS b FROM ({opened('way')}) w LEFT JOIN counts c USING (g) WHERE w.rn = coalesce(c.n, 0)
), edits AS (
    SELECT g, unnest(string_split(b.s, '')) AS edit, unnest(range(1, length(b.s) + 1)) AS pos FROM best WHERE b.s <> ''
), numbered AS (
    SELECT *, count(*) FILTER (edit <> 'I') OVER w AS at, count(*) FILTER (edit <> 'D') OVER w AS made, count(*) FILTER (edit <> 'D') OVER (PARTITION BY g) AS total
    FROM edits WINDOW w AS (PARTITION BY g ORDER BY pos)
), lines AS (
    SELECT n.g, n.pos, CASE WHEN edit = 'K' THEN f.role WHEN (made - 1 - total % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END AS line
    FROM numbered n LEFT JOIN faults f ON f.g = n.g AND f.rn = n.at WHERE edit <> 'D'
), texts AS (
    SELECT g, string_agg(line, chr(10) ORDER BY pos) AS t FROM lines GROUP BY g
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, b.c AS cost, b.s AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM every JOIN best USING (g) LEFT JOIN counts USING (g) LEFT JOIN texts USING (g)
"""


@query("op13_conversation_repair", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(_read(spark, sf_dir, "conversations")), dropped="dropped")
