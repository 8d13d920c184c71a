"""Queries: exploratory statistics, preprocessing, re-balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk.datasets import TX_SQL, VECTORS_SQL, table, transactions, vectors
from txrisk.functions.random import det_rand
from txrisk.operators import clean, explore, hashing, knn, prep, sampling
from txrisk.plans.registry import R, query, r, rand_sql, rounded
from txrisk.session import scratch_path


def _tx(sql: str) -> str:
    return f"WITH {TX_SQL} {sql}"


def _vec(sql: str) -> str:
    return f"WITH {VECTORS_SQL} {sql}"


SCORES = ["amount", "time_since_last_transaction", "spending_deviation_score", "velocity_score", "geo_anomaly_score"]

# ---- exploratory statistics ------------------------------------------------------------


@query(
    "missing_summary",
    _tx(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, 100.0::DOUBLE * (count(*) - count({c})) / count(*) AS missing_pct FROM tx"
            for c in ["amount", "device_used", "fraud_type", "geo_anomaly_score", "spending_deviation_score", "time_since_last_transaction"]
        )
        + ") WHERE missing > 0"
    ),
)
def _(spark, d):
    return explore.missing_summary(transactions(spark, d))


def _describe(value: str) -> str:
    return (
        f"count({value}) AS n, {R(f'avg({value})')} AS mean, {R(f'stddev_samp({value})')} AS std, min({value})::DOUBLE AS min, "
        f"max({value})::DOUBLE AS max, " + ", ".join(f"{R(f'quantile_cont({value}, {p})')} AS {n}" for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75")))
    )


_QUARTS = ["mean", "std", "q25", "median", "q75"]


@query("describe_numeric", _tx(" UNION ALL ".join(f"SELECT '{c}' AS feature, {_describe(c)} FROM tx" for c in SCORES)))
def _(spark, d):
    return rounded(explore.describe_numeric(transactions(spark, d), SCORES), *_QUARTS)


@query("describe_by_label", _tx(f"SELECT is_fraud, {_describe('amount')} FROM tx GROUP BY is_fraud"))
def _(spark, d):
    return rounded(explore.describe_by_label(transactions(spark, d), "amount", "is_fraud"), *_QUARTS)


@query("label_distribution", _tx(f"SELECT is_fraud, count(*) AS n, {R('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM tx GROUP BY is_fraud"))
def _(spark, d):
    return rounded(explore.label_distribution(transactions(spark, d), "is_fraud"), "pct")


@query("value_counts", _tx("SELECT merchant_category, count(*) AS n FROM tx GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"))
def _(spark, d):
    return explore.value_counts(transactions(spark, d), "merchant_category", 10)


@query("fraud_type_counts", _tx("SELECT fraud_type, count(*) AS n FROM tx WHERE is_fraud GROUP BY 1"))
def _(spark, d):
    return explore.fraud_type_counts(transactions(spark, d))


@query(
    "counts_by_time_label",
    _tx(
        """SELECT hour(timestamp) AS part, count(*) FILTER (NOT is_fraud) AS normal, count(*) FILTER (is_fraud) AS fraud
        FROM tx GROUP BY 1"""
    ),
)
def _(spark, d):
    return explore.counts_by_time_label(transactions(spark, d), F.hour("timestamp"), "is_fraud")


@query("fraud_rate_by_category", _tx(f"SELECT merchant_category, {R('100 * avg(is_fraud::INTEGER)')} AS fraud_pct FROM tx GROUP BY 1 ORDER BY avg(is_fraud::INTEGER) DESC, 1 LIMIT 10"))
def _(spark, d):
    return rounded(explore.fraud_rate_by_category(transactions(spark, d), "merchant_category", "is_fraud"), "fraud_pct")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})')} AS corr FROM lineitem"
        for a in _MEASURES
        for b in _MEASURES
    ),
)
def _(spark, d):
    return rounded(explore.correlation_matrix(table(spark, d, "lineitem"), _MEASURES), "corr")


@query(
    "target_correlation_topk",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {R(f'corr({c}, l_quantity)')} AS corr FROM lineitem" for c in _MEASURES if c != "l_quantity"
    )
    + ") ORDER BY corr DESC LIMIT 2",
)
def _(spark, d):
    return rounded(explore.target_correlation_topk(table(spark, d, "lineitem"), _MEASURES, "l_quantity", 2), "corr")


def _hist_sql(value: str, where: str = "true") -> str:
    return (
        f", v AS (SELECT is_fraud, {value} AS v FROM tx WHERE {where}), b AS (SELECT min(v) AS lo, max(v) AS hi FROM v) "
        f"SELECT is_fraud, least(floor((v - lo) * 50 / (hi - lo)), 49)::INTEGER AS bucket, count(*) AS n, "
        f"{R('min(lo + least(floor((v - lo) * 50 / (hi - lo)), 49) * (hi - lo) / 50)')} AS lower FROM v, b GROUP BY 1, 2"
    )


@query("histogram_by_label", _tx(_hist_sql("amount")))
def _(spark, d):
    return rounded(explore.histogram_by_label(transactions(spark, d), "amount", "is_fraud"), "lower")


@query("histogram_by_label_log", _tx(_hist_sql("ln(1 + amount)", "amount >= 0")))
def _(spark, d):
    return rounded(explore.log_histogram_by_label(transactions(spark, d), "amount", "is_fraud"), "lower")


@query(
    "boxplot_by_label",
    _tx(
        f""", q AS (SELECT is_fraud, quantile_cont(amount, 0.25) AS q25, quantile_cont(amount, 0.5) AS median,
            quantile_cont(amount, 0.75) AS q75 FROM tx GROUP BY 1)
        SELECT is_fraud, {R('max(q25)')} AS q25, {R('max(median)')} AS median, {R('max(q75)')} AS q75,
          min(amount) FILTER (amount BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_low,
          max(amount) FILTER (amount BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_high,
          count(*) FILTER (NOT amount BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS outliers
        FROM tx JOIN q USING (is_fraud) GROUP BY 1"""
    ),
)
def _(spark, d):
    return rounded(explore.boxplot_by_label(transactions(spark, d), "amount", "is_fraud"), "q25", "median", "q75")


@query(
    "class_weights",
    _tx(f"SELECT transaction_type, count(*) AS n, {R('sum(count(*)) OVER () / (count(*) OVER () * count(*))')} AS weight FROM tx GROUP BY 1"),
)
def _(spark, d):
    return rounded(explore.class_weights(transactions(spark, d), "transaction_type"), "weight")


@query("class_weights_ratio", _tx("SELECT is_fraud, count(*) AS n, CASE WHEN is_fraud THEN 25.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM tx GROUP BY 1"))
def _(spark, d):
    return explore.class_weights(transactions(spark, d), "is_fraud", ratio=25.0)


@query("sample_head", _tx("SELECT transaction_id, sender_account, amount FROM tx ORDER BY transaction_id LIMIT 20"))
def _(spark, d):
    return explore.sample_head(transactions(spark, d).select("transaction_id", "sender_account", "amount"), ["transaction_id"], 20)


@query("topk", _tx("SELECT transaction_id, amount FROM tx ORDER BY amount DESC, transaction_id LIMIT 10"))
def _(spark, d):
    return explore.topk(transactions(spark, d).select("transaction_id", "amount"), "amount", 10, "transaction_id")


@query("distinct_values", _tx("SELECT DISTINCT merchant_category FROM tx"))
def _(spark, d):
    return explore.distinct_values(transactions(spark, d), "merchant_category")


# ---- preprocessing ---------------------------------------------------------------------

_COLS = ["amount", "velocity_score"]


@query(
    "standardize",
    _tx(
        f""", s AS (SELECT avg(amount) AS ma, stddev_pop(amount) AS sa, avg(velocity_score) AS mv, stddev_pop(velocity_score) AS sv
          FROM tx WHERE timestamp < TIMESTAMP '2024-01-16')
        SELECT transaction_id, {R('(amount - ma) / sa')} AS amount, {R('(velocity_score - mv) / sv')} AS velocity_score FROM tx, s"""
    ),
)
def _(spark, d):
    tx = transactions(spark, d)
    train = tx.filter(F.col("timestamp") < F.lit("2024-01-16").cast("timestamp"))
    return rounded(prep.standardize(tx.select("transaction_id", *_COLS), _COLS, train), *_COLS)


@query(
    "one_hot",
    _tx("SELECT transaction_id, " + ", ".join(f"coalesce(payment_channel = '{v}', false)::INTEGER AS payment_channel_{v}" for v in ("ch0", "ch1", "ch2")) + " FROM tx"),
)
def _(spark, d):
    tx = transactions(spark, d).select("transaction_id", "payment_channel")
    return prep.one_hot(tx, "payment_channel", prep.fit_categories(tx, "payment_channel")).drop("payment_channel")


def _preprocess_sql() -> str:
    """Learned on the first half of the rows by time, applied to all of them."""
    texts = ["device_used", "payment_channel"]
    fills = [f"quantile_cont({c}, 0.5) AS {c}" for c in SCORES]
    filled = [f"coalesce(t.{c}, f.{c}) AS {c}" for c in SCORES]
    moments = [f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCORES]
    tops = ", ".join(
        f"top_{c} AS (SELECT {c} AS v FROM train WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), seen_{c} AS (SELECT DISTINCT {c} AS v FROM train WHERE {c} IS NOT NULL)"
        for c in texts
    )
    slots = [f"SELECT transaction_id, '{c}' AS slot, (coalesce(tx.{c}, f.{c}) - m_{c}) / s_{c} AS value FROM tx, fills f, moments" for c in SCORES]
    slots += [
        f"SELECT transaction_id, '{c}=' || seen_{c}.v, CASE WHEN coalesce(tx.{c}, top_{c}.v) = seen_{c}.v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM tx, seen_{c}, top_{c}"
        for c in texts
    ]
    return f"""WITH {TX_SQL}, train AS (SELECT * FROM tx WHERE transaction_id % 4 <> 0 AND coalesce(device_used, 'x') <> 'dev1'),
      fills AS (SELECT {', '.join(fills)} FROM train), filled AS (SELECT {', '.join(filled)} FROM train t, fills f),
      moments AS (SELECT {', '.join(moments)} FROM filled), {tops}, slots AS ({' UNION ALL '.join(slots)})
      SELECT transaction_id, slot, {R('value')} AS value FROM slots"""


@query("preprocess_pipeline", _preprocess_sql())
def _(spark, d):
    """Learned on rows without one of the devices, saved, read back and applied to all rows."""
    from pyspark.ml.functions import vector_to_array

    tx = transactions(spark, d)
    train = tx.filter((F.col("transaction_id") % 4 != 0) & (F.coalesce("device_used", F.lit("x")) != "dev1"))
    path = scratch_path(spark, "preprocessor")
    prep.preprocess_pipeline(SCORES, ["device_used", "payment_channel"]).fit(train).write().save(path)
    model = prep.PreprocessorModel.load(path)
    out = model.transform(tx).select("transaction_id", F.posexplode(vector_to_array("features")).alias("at", "value"))
    return rounded(out.select("transaction_id", F.get(F.lit(model.names()), F.col("at")).alias("slot"), "value"), "value")


def _split_sql(key: str) -> str:
    return f"""WITH {TX_SQL}, n AS (SELECT transaction_id, count(*) OVER ({key}) AS n,
        row_number() OVER ({key} ORDER BY {rand_sql('transaction_id', 42)}, transaction_id) AS rk FROM tx)
      SELECT transaction_id, CASE WHEN rk <= round_even(0.2 * n, 0) THEN 'test'
        WHEN rk <= round_even(0.2 * n, 0) + round_even(0.25 * (n - round_even(0.2 * n, 0)), 0) THEN 'val' ELSE 'train' END AS split FROM n"""


@query("split_stratified", _split_sql("PARTITION BY is_fraud"))
def _(spark, d):
    return prep.split_stratified(transactions(spark, d), "is_fraud", "transaction_id").select("transaction_id", "split")


@query("split_by_account", _split_sql("PARTITION BY sender_account"))
def _(spark, d):
    """As many strata as accounts."""
    return prep.split_stratified(transactions(spark, d), "sender_account", "transaction_id").select("transaction_id", "split")


@query("split_random", _split_sql("PARTITION BY 1"))
def _(spark, d):
    return prep.split_random(transactions(spark, d), "transaction_id").select("transaction_id", "split")


# ---- re-balancing ----------------------------------------------------------------------


def _ranked(salt: int = 42) -> str:
    return f"""rk AS (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY {rand_sql('transaction_id', salt)}, transaction_id) AS rk FROM tx),
      c AS (SELECT count(*) FILTER (is_fraud) AS pos, count(*) FILTER (NOT is_fraud) AS neg FROM tx)"""


@query(
    "undersample",
    _tx(f", {_ranked()} SELECT transaction_id, is_fraud FROM rk, c WHERE is_fraud OR rk <= floor(pos / 0.5)"),
)
def _(spark, d):
    return sampling.undersample(transactions(spark, d), "is_fraud", "transaction_id", 0.5).select("transaction_id", "is_fraud")


@query(
    "oversample",
    _tx(
        f""", {_ranked()}, m AS (SELECT transaction_id, is_fraud,
          CASE WHEN is_fraud THEN floor(0.8 * neg)::BIGINT // pos + (rk <= floor(0.8 * neg)::BIGINT % pos)::BIGINT ELSE 1 END AS copies FROM rk, c)
        SELECT transaction_id, is_fraud, unnest(range(1, copies + 1))::INTEGER AS copy FROM m"""
    ),
)
def _(spark, d):
    return sampling.oversample(transactions(spark, d), "is_fraud", "transaction_id", 0.8).select("transaction_id", "is_fraud", "copy")


# Distances between every minority row and every row, written out once for all oracles below.
_PAIRS = """
p AS (SELECT a.id AS query_id, b.id AS neighbor_id, (b.label = 0)::INTEGER AS big, b.label AS nlabel,
        sqrt(list_sum(list_transform(list_zip(a.features, b.features), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance
      FROM vectors a JOIN vectors b ON a.id <> b.id WHERE a.label = 1),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM p),
own AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM p WHERE nlabel = 1)"""


@query("knn_topk", _vec(f", {_PAIRS} SELECT query_id, neighbor_id, rank::INTEGER AS rank, {R('distance')} AS distance FROM near WHERE rank <= 5"))
def _(spark, d):
    v = vectors(spark, d)
    pairs = knn.knn_topk(v.filter("label = 1"), v, 5)
    return rounded(pairs.select("query_id", "neighbor_id", "rank", "distance"), "distance")


_SIZES = "s AS (SELECT count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM vectors)"


def _made_sql(copies: str) -> str:
    """Synthetic rows from a relation copies(id, copies): seed, copy, neighbour, gap, sum of the features."""
    drawn = "seed_id::VARCHAR || ':' || copy::VARCHAR"
    pick, gap = rand_sql(f"({drawn})", "42-n"), rand_sql(f"({drawn})", "42-g")
    return f"""{copies},
    k AS (SELECT query_id, count(*) AS k FROM own WHERE rank <= 5 GROUP BY 1),
    e AS (SELECT id AS seed_id, unnest(range(1, copies + 1))::INTEGER AS copy FROM copies WHERE copies > 0),
    g AS (SELECT seed_id, copy, {gap} AS gap, 1 + floor({pick} * k)::BIGINT AS pick FROM e JOIN k ON seed_id = query_id)
    SELECT seed_id, copy, o.neighbor_id, {R('gap')} AS gap,
      {R('list_sum(list_transform(list_zip(a.features, b.features), lambda z: z[1] + gap * (z[2] - z[1])))', 4)} AS total
    FROM g JOIN own o ON o.query_id = seed_id AND o.rank = pick JOIN vectors a ON a.id = seed_id JOIN vectors b ON b.id = o.neighbor_id"""


def _made(df):
    total = F.aggregate("features", F.lit(0.0), lambda a, b: a + b)
    new = df.filter("synthetic").select("seed_id", "copy", "neighbor_id", r(F.col("gap")).alias("gap"), r(total, 4).alias("total"))
    return new


def _share_sql(selection: str, wanted: str) -> str:
    return f"""sel AS ({selection}), n AS (SELECT count(*) AS n FROM sel), w AS (SELECT greatest({wanted}, 0)::BIGINT AS wanted FROM s),
    copies AS (SELECT id, wanted // n + (row_number() OVER (ORDER BY {rand_sql('id', 42)}, id) <= wanted % n)::BIGINT AS copies FROM sel, n, w)"""


_HALF = "floor(0.5 * neg) - pos"


@query("smote", _vec(f", {_PAIRS}, {_SIZES}, {_made_sql(_share_sql('SELECT id FROM vectors WHERE label = 1', _HALF))}"))
def _(spark, d):
    return _made(sampling.smote(vectors(spark, d)))


_DENSITY = """dens AS (SELECT query_id AS id, sum(big) / 5.0::DOUBLE AS density FROM near WHERE rank <= 5 GROUP BY 1),
    tot AS (SELECT sum(density) AS total, count(*) AS n FROM dens),
    copies AS (SELECT id, density, CASE WHEN total > 0 THEN density / total ELSE 1.0 / n END AS weight,
      round_even((CASE WHEN total > 0 THEN density / total ELSE 1.0 / n END) * floor(0.5 * (neg - pos)), 0)::BIGINT AS copies FROM dens, tot, s)"""


@query("adasyn_density", _vec(f", {_PAIRS}, {_SIZES}, {_DENSITY} SELECT id, {R('density')} AS density, {R('weight')} AS weight, copies FROM copies"))
def _(spark, d):
    return rounded(sampling.adasyn_density(vectors(spark, d)), "density", "weight")


@query("adasyn", _vec(f", {_PAIRS}, {_SIZES}, {_made_sql(_DENSITY)}"))
def _(spark, d):
    return _made(sampling.adasyn(vectors(spark, d)))


_ZONES = """z AS (SELECT query_id AS id, sum(big)::BIGINT AS majority_neighbors,
      CASE WHEN sum(big) = 10 THEN 'noise' WHEN sum(big) > 5 THEN 'danger' ELSE 'safe' END AS zone FROM near WHERE rank <= 10 GROUP BY 1)"""


@query("borderline_zones", _vec(f", {_PAIRS}, {_ZONES} SELECT id, majority_neighbors, zone FROM z"))
def _(spark, d):
    return sampling.borderline_zones(vectors(spark, d))


_SELECT_ZONES = "SELECT id FROM z WHERE zone IN ('danger', 'noise') UNION ALL SELECT id FROM z WHERE NOT EXISTS (SELECT 1 FROM z WHERE zone IN ('danger', 'noise'))"


@query("borderline_smote", _vec(f", {_PAIRS}, {_SIZES}, {_ZONES}, {_made_sql(_share_sql(_SELECT_ZONES, _HALF))}"))
def _(spark, d):
    return _made(sampling.borderline_smote(vectors(spark, d), kind="borderline2"))


@query(
    "cluster_smote",
    _vec(f", {_SIZES} SELECT 'on a segment of one cluster' AS made, count(*) AS n FROM (SELECT unnest(range(floor(0.5 * neg)::BIGINT - pos)) FROM s)"),
)
def _(spark, d):
    """Each synthetic row lies between two minority rows of one cluster, at its gap; nothing else is made."""
    v = vectors(spark, d)
    out = sampling.cluster_smote(v)
    small = v.filter("label = 1").select("id", "features")
    a, b = small.toDF("seed_id", "x"), small.toDF("neighbor_id", "y")
    new = out.filter("synthetic").select("seed_id", "neighbor_id", "gap", "features", "label").join(a, "seed_id", "left").join(b, "neighbor_id", "left")
    point = F.zip_with(F.col("x"), F.col("y"), lambda p, q: p + F.col("gap") * (q - p))
    off = F.aggregate(F.zip_with(point, F.col("features"), lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, v: F.greatest(s, v))
    fits = (off < 1e-9) & (F.col("label") == 1) & F.col("gap").between(0, 1) & (F.col("seed_id") != F.col("neighbor_id"))
    made = F.when(fits, "on a segment of one cluster").otherwise("elsewhere")
    return new.groupBy(made.alias("made")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "rebalance",
    _vec(f", {_SIZES} SELECT label, count(*) + CASE WHEN label = 1 THEN greatest(floor(0.5 * max(neg)) - max(pos), 0)::BIGINT ELSE 0 END AS n FROM vectors, s GROUP BY label"),
)
def _(spark, d):
    return sampling.rebalance(vectors(spark, d), "smote").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _stratum_sql(pool: str, column: str, wanted: str, name: str) -> str:
    """Equal shares over the strata, then the remainder in hash order from what is left."""
    return f"""{name}_r AS (SELECT transaction_id, {column} AS st, row_number() OVER (PARTITION BY {column} ORDER BY {rand_sql('transaction_id', 42)}, transaction_id) AS rk FROM tx WHERE {pool}),
    {name}_p AS (SELECT count(DISTINCT st) AS types, {wanted} // count(DISTINCT st) AS each, {wanted} % count(DISTINCT st) AS rest FROM {name}_r),
    {name}_t AS (SELECT transaction_id FROM {name}_r, {name}_p WHERE st IS NOT NULL AND rk <= each),
    {name}_f AS (SELECT transaction_id FROM {name}_r WHERE transaction_id NOT IN (SELECT transaction_id FROM {name}_t)
      ORDER BY {rand_sql('transaction_id', 42)}, transaction_id
      LIMIT (SELECT least(rest, {wanted} - (SELECT count(*) FROM {name}_t)) FROM {name}_p)),
    {name} AS (SELECT * FROM {name}_t UNION ALL SELECT * FROM {name}_f)"""


@query(
    "balanced_sample",
    _tx(
        f""", {_stratum_sql('is_fraud', 'fraud_type', '300', 'fr')}, {_stratum_sql('NOT is_fraud', 'transaction_type', '700', 'nr')}
        SELECT transaction_id, is_fraud, fraud_type, transaction_type FROM tx
        WHERE (is_fraud AND (SELECT count(*) FROM tx WHERE is_fraud) < 300) OR transaction_id IN (SELECT transaction_id FROM fr UNION ALL SELECT transaction_id FROM nr)"""
    ),
)
def _(spark, d):
    tx = transactions(spark, d).select("transaction_id", "is_fraud", "fraud_type", "transaction_type")
    return sampling.balanced_sample(tx, "transaction_id", 1000)


@query(
    "balanced_sample_by_account",
    _tx(
        f""", {_stratum_sql('is_fraud', 'sender_account', '300', 'fr')}, {_stratum_sql('NOT is_fraud', 'sender_account', '700', 'nr')}
        SELECT transaction_id, is_fraud, sender_account FROM tx
        WHERE (is_fraud AND (SELECT count(*) FROM tx WHERE is_fraud) < 300) OR transaction_id IN (SELECT transaction_id FROM fr UNION ALL SELECT transaction_id FROM nr)"""
    ),
)
def _(spark, d):
    """As many strata as accounts."""
    tx = transactions(spark, d).select("transaction_id", "is_fraud", "sender_account")
    return sampling.balanced_sample(tx, "transaction_id", 1000, fraud_type="sender_account", kind="sender_account")


@query("shuffle_rows", _tx(f"SELECT transaction_id, {R(rand_sql('transaction_id', 1))} AS position FROM tx ORDER BY position, transaction_id"))
def _(spark, d):
    shuffled = hashing.shuffle_rows(transactions(spark, d).select("transaction_id"), "transaction_id")
    return shuffled.withColumn("position", r(det_rand(F.col("transaction_id"), 1)))


@query(
    "first_by_hash",
    _tx(f"SELECT transaction_id, transaction_type FROM (SELECT *, row_number() OVER (PARTITION BY transaction_type ORDER BY {rand_sql('transaction_id', 9)}, transaction_id) AS rk FROM tx) WHERE rk <= 100"),
)
def _(spark, d):
    tx = transactions(spark, d).select("transaction_id", "transaction_type")
    counts = hashing.key_counts(tx, "transaction_type")
    return hashing.first_by_hash(tx, "transaction_type", "transaction_id", 9, {k: 100 for k in counts}, counts)


@query("column_quantiles", _tx(" UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'quantile_cont({c}, 0.9)')} AS q90, {R(f'quantile_cont({c}, 0.99)')} AS q99 FROM tx" for c in SCORES)))
def _(spark, d):
    from txrisk.operators.ordering import exact_quantiles

    long = clean.unpivot_numeric(transactions(spark, d), SCORES)
    q = exact_quantiles(long, "value", [0.9, 0.99], ["feature"])
    return q.select("feature", r(F.get("quantiles", F.lit(0))).alias("q90"), r(F.get("quantiles", F.lit(1))).alias("q99"))
