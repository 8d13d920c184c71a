"""Class re-balancing.

Tables have a row id, a feature array and a 0/1-like label; the minority is the least frequent
label. Over-sampling operators return original and synthetic rows together: ``synthetic`` tells
them apart, ``seed_id``/``neighbor_id``/``copy`` say where a synthetic row came from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.random import det_rand
from txrisk.functions.vectors import interpolate
from txrisk.operators.aggregate import remaining_rows
from txrisk.operators.hashing import LITERAL_KEYS, few_counts, first_by_hash, hash_cuts, key_counts, rank_at_most, shuffle_rows, with_hash
from txrisk.operators.knn import knn_topk, overall
from txrisk.operators.ordering import group_rank, stored


def classes(df: DataFrame, label: str) -> tuple[object, object, int, int]:
    """(minority label, majority label, minority rows, majority rows)."""
    counts = sorted(key_counts(df, label).items(), key=lambda kv: (kv[1], str(kv[0])))
    if len(counts) < 2:
        raise ValueError("re-balancing needs two classes")
    return counts[0][0], counts[-1][0], counts[0][1], counts[-1][1]


def undersample(df: DataFrame, label: str, row_id: str, ratio: float = 1.0, salt: int = 42) -> DataFrame:
    """Random majority rows are dropped until minority / majority = ratio: a filter, no shuffle."""
    counts = key_counts(df, label)
    _, big, n_small, n_big = classes(df, label)
    limits = {**counts, big: min(n_big, int(n_small / ratio))}
    return first_by_hash(df, label, row_id, salt, limits, counts)


def oversample(df: DataFrame, label: str, row_id: str, ratio: float = 1.0, salt: int = 42) -> DataFrame:
    """Minority rows are repeated until minority / majority = ratio; ``copy`` numbers the repeats."""
    counts = key_counts(df, label)
    small, _, n_small, n_big = classes(df, label)
    wanted = max(n_small, int(ratio * n_big))
    others = {k: n for k, n in counts.items() if k != small}
    shares = equal_shares(df, label, row_id, salt, {**others, small: wanted}, counts)
    return expand_copies(shares, "copies", wanted // n_small + 1).drop("copies")


#: Copies one task makes of one row before they are spread over several tasks.
COPIES_PER_TASK = 1_000_000


def expand_copies(df: DataFrame, copies: str, most: int) -> DataFrame:
    """One row per copy, numbered from 1 in ``copy``. ``most`` bounds the copies of any row.

    A row with very many copies is first cut into ranges, which are spread over tasks.
    """
    if most <= COPIES_PER_TASK:
        return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(copies))))
    starts = F.sequence(F.lit(1), F.col(copies), F.lit(COPIES_PER_TASK))
    ranges = df.withColumn("_start", F.explode(starts)).repartition("_start")
    stop = F.least(F.col("_start") + COPIES_PER_TASK - 1, F.col(copies))
    return ranges.withColumn("copy", F.explode(F.sequence(F.col("_start"), stop))).drop("_start")


def equal_shares(df: DataFrame, key: str, row_id: str, salt, totals: dict, counts: dict) -> DataFrame:
    """Add ``copies``: ``totals[key]`` spread over the rows of each listed key, 0 for other keys.

    Every row gets the integer quotient, the first rows in hash order one more.
    """
    extra = {k: t % counts[k] for k, t in totals.items()}
    cuts = hash_cuts(df, F.col(key), row_id, salt, counts, {k: [e] for k, e in extra.items()})
    hashed = with_hash(df, row_id, salt)
    marked = rank_at_most(hashed, F.col(key), row_id, counts, {"_more": extra}, cuts)
    shares = [(k, t // counts[k]) for k, t in totals.items()]
    if len(shares) <= LITERAL_KEYS:
        whole = F.lit(0)
        for k, share in shares:
            whole = F.when(F.col(key).eqNullSafe(F.lit(k)), share).otherwise(whole)
    else:
        schema = T.StructType([T.StructField("_skey", df.schema[key].dataType), T.StructField("_share", T.LongType())])
        table = df.sparkSession.createDataFrame(shares, schema)
        marked = marked.join(F.broadcast(table), F.col(key).eqNullSafe(F.col("_skey")), "left")
        whole = F.coalesce("_share", F.lit(0))
    return marked.withColumn("copies", (whole + F.col("_more").cast("int")).cast("int")).drop("_u", "_more", "_skey", "_share")


def _neighbour_lists(pairs: DataFrame) -> DataFrame:
    """At most k neighbour ids per seed, nearest first."""
    packed = F.sort_array(F.collect_list(F.struct("rank", "neighbor_id")))
    return pairs.groupBy(F.col("query_id").alias("seed_id")).agg(F.transform(packed, lambda p: p["neighbor_id"]).alias("_near"))


def synthesize(
    seeds: DataFrame, minority: DataFrame, pairs: DataFrame, row_id: str, features: str, salt: int, most: int
) -> DataFrame:
    """``copies`` (at most ``most``) new points per seed, each on the segment to a random neighbour of it.

    A seed without a neighbour (the only one of its class) is repeated.
    """
    drawn = F.concat_ws(":", F.col("seed_id").cast("string"), F.col("copy").cast("string"))
    listed = (
        seeds.filter(F.col("copies") > 0)
        .select(F.col(row_id).alias("seed_id"), F.col(features).alias("_x"), "copies")
        .join(_neighbour_lists(pairs), "seed_id", "left")
        .withColumn("_near", F.coalesce("_near", F.array("seed_id")))
    )
    expanded = (
        expand_copies(listed, "copies", most)
        .withColumn("_pick", F.floor(det_rand(drawn, f"{salt}-n") * F.size("_near")).cast("int"))
        .select(
            "seed_id",
            "copy",
            "_x",
            F.get("_near", F.col("_pick")).alias("neighbor_id"),
            det_rand(drawn, f"{salt}-g").alias("gap"),
        )
    )
    ends = minority.select(F.col(row_id).alias("neighbor_id"), F.col(features).alias("_y"))
    return expanded.join(ends, "neighbor_id").select(
        "seed_id", "copy", "neighbor_id", "gap", interpolate(F.col("_x"), F.col("_y"), F.col("gap")).alias(features)
    )


def _with_originals(df: DataFrame, made: DataFrame, row_id: str, features: str, label: str, minority) -> DataFrame:
    kind = df.schema[row_id].dataType
    originals = df.select(
        F.col(row_id),
        F.col(features).cast("array<double>").alias(features),
        F.col(label),
        F.lit(False).alias("synthetic"),
        F.lit(None).cast(kind).alias("seed_id"),
        F.lit(None).cast(kind).alias("neighbor_id"),
        F.lit(None).cast("int").alias("copy"),
        F.lit(None).cast("double").alias("gap"),
    )
    new = made.select(
        F.lit(None).cast(kind).alias(row_id),
        features,
        F.lit(minority).cast(df.schema[label].dataType).alias(label),
        F.lit(True).alias("synthetic"),
        F.col("seed_id").cast(kind).alias("seed_id"),
        F.col("neighbor_id").cast(kind).alias("neighbor_id"),
        "copy",
        "gap",
    )
    return originals.unionByName(new)


def _prepare(df: DataFrame, label: str, features: str):
    small, big, n_small, n_big = classes(df, label)
    typed = df.withColumn(features, F.col(features).cast("array<double>"))
    return typed, typed.filter(F.col(label) == F.lit(small)), small, big, n_small, n_big


def smote(
    df: DataFrame, label: str = "label", row_id: str = "id", features: str = "features",
    ratio: float = 0.5, k: int = 5, salt: int = 42,
) -> DataFrame:
    """Synthetic minority rows until minority / majority = ratio."""
    typed, minority, small, _, n_small, n_big = _prepare(df, label, features)
    wanted = max(0, int(ratio * n_big) - n_small)
    seeds = equal_shares(minority, label, row_id, salt, {small: wanted}, {small: n_small})
    pairs = knn_topk(minority, minority, k, row_id, features)
    return _with_originals(typed, synthesize(seeds, minority, pairs, row_id, features, salt, wanted // n_small + 1), row_id, features, label, small)


def _near_both(df: DataFrame, minority: DataFrame, label: str, small, big, k: int, row_id: str, features: str) -> DataFrame:
    """One search: each minority row's k nearest rows of the minority (tag 0), the majority (1) and the rest (2)."""
    tagged = df.withColumn("_big", F.when(F.col(label) == F.lit(small), 0).when(F.col(label) == F.lit(big), 1).otherwise(2))
    return stored(knn_topk(minority, tagged, k, row_id, features, tag="_big", per_tag=True))[0]


def _density(pairs: DataFrame, row_id: str, k: int, wanted: int, n_small: int) -> DataFrame:
    density = overall(pairs, k).groupBy(F.col("query_id").alias(row_id)).agg((F.count_if(F.col("neighbor_tag") == 1) / float(k)).alias("density"))
    total = density.agg(F.sum("density")).scalar()
    weight = F.when(total > 0, F.col("density") / total).otherwise(1.0 / n_small)
    return density.withColumn("weight", weight).withColumn("copies", F.bround(F.col("weight") * wanted).cast("int"))


def adasyn_density(
    df: DataFrame, label: str = "label", row_id: str = "id", features: str = "features", k: int = 5, beta: float = 0.5
) -> DataFrame:
    """Share of majority rows among each seed's neighbours, its normalised weight and its copies."""
    typed, minority, small, big, n_small, n_big = _prepare(df, label, features)
    pairs = _near_both(typed, minority, label, small, big, k, row_id, features)
    return _density(pairs, row_id, k, max(0, int(beta * (n_big - n_small))), n_small)


def adasyn(
    df: DataFrame, label: str = "label", row_id: str = "id", features: str = "features",
    beta: float = 0.5, k: int = 5, salt: int = 42,
) -> DataFrame:
    """More synthetic rows where a minority row is surrounded by the majority."""
    typed, minority, small, big, n_small, n_big = _prepare(df, label, features)
    wanted = max(0, int(beta * (n_big - n_small)))
    pairs = _near_both(typed, minority, label, small, big, k, row_id, features)
    seeds = minority.join(_density(pairs, row_id, k, wanted, n_small).select(row_id, "copies"), row_id)
    made = synthesize(seeds, minority, _same_class(pairs, k), row_id, features, salt, wanted + 1)
    return _with_originals(typed, made, row_id, features, label, small)


def _same_class(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.filter((F.col("neighbor_tag") == 0) & (F.col("rank") <= k))


def _zones(pairs: DataFrame, row_id: str, m: int) -> DataFrame:
    around = overall(pairs, m).groupBy(F.col("query_id").alias(row_id)).agg(F.count_if(F.col("neighbor_tag") == 1).alias("majority_neighbors"))
    zone = F.when(F.col("majority_neighbors") == m, "noise").when(F.col("majority_neighbors") > m // 2, "danger")
    return around.withColumn("zone", zone.otherwise("safe"))


def borderline_zones(
    df: DataFrame, label: str = "label", row_id: str = "id", features: str = "features", m: int = 10
) -> DataFrame:
    """Each minority row as noise, danger or safe by the majority among its ``m`` neighbours."""
    typed, minority, small, big, *_ = _prepare(df, label, features)
    return _zones(_near_both(typed, minority, label, small, big, m, row_id, features), row_id, m)


def borderline_smote(
    df: DataFrame, label: str = "label", row_id: str = "id", features: str = "features",
    ratio: float = 0.5, k: int = 5, m: int = 10, kind: str = "borderline1", salt: int = 42,
) -> DataFrame:
    """SMOTE from the rows near the border only (all of them when none is)."""
    zones = {"borderline1": ["danger"], "borderline2": ["danger", "noise"]}
    if kind not in zones:
        raise ValueError(f"unknown kind: {kind}")
    typed, minority, small, big, n_small, n_big = _prepare(df, label, features)
    pairs = _near_both(typed, minority, label, small, big, max(k, m), row_id, features)
    chosen = _zones(pairs, row_id, m).filter(F.col("zone").isin(zones[kind]))
    selected = minority.join(chosen.select(row_id), row_id, "left_semi")
    n_selected = selected.count()
    if n_selected == 0:
        selected, n_selected = minority, n_small
    wanted = max(0, int(ratio * n_big) - n_small)
    seeds = equal_shares(selected, label, row_id, salt, {small: wanted}, {small: n_selected})
    made = synthesize(seeds, minority, _same_class(pairs, k), row_id, features, salt, wanted // n_selected + 1)
    return _with_originals(typed, made, row_id, features, label, small)


def cluster_smote(
    df: DataFrame, label: str = "label", row_id: str = "id", features: str = "features",
    ratio: float = 0.5, k: int = 5, n_clusters: int = 3, salt: int = 42,
) -> DataFrame:
    """SMOTE inside k-means clusters of the minority, the same quota per cluster."""
    typed, minority, small, _, n_small, n_big = _prepare(df, label, features)
    wanted = max(0, int(ratio * n_big) - n_small)
    count = min(n_clusters, n_small)
    vectors = minority.withColumn("_v", array_to_vector(features))
    if count > 1:
        model = KMeans(k=count, seed=salt, featuresCol="_v", predictionCol="cluster").fit(vectors)
        clustered = model.transform(vectors).drop("_v")
    else:
        clustered = vectors.drop("_v").withColumn("cluster", F.lit(0))
    sizes = key_counts(clustered, "cluster")
    quotas = {
        c: wanted // count + (1 if c < wanted % count else 0) for c in range(count) if sizes.get(c, 0) > 1
    }
    most = max((q // sizes[c] + 1 for c, q in quotas.items()), default=1)
    seeds = equal_shares(clustered.filter(F.col("cluster").isin(list(quotas))), "cluster", row_id, salt, quotas, sizes)
    pairs = knn_topk(clustered, clustered, k, row_id, features, group="cluster")
    return _with_originals(typed, synthesize(seeds, minority, pairs, row_id, features, salt, most), row_id, features, label, small)


TECHNIQUES: dict[str, Callable[..., DataFrame]] = {
    "smote": smote,
    "adasyn": adasyn,
    "borderline_smote": borderline_smote,
    "cluster_smote": cluster_smote,
    "undersample": undersample,
    "oversample": oversample,
}


def rebalance(df: DataFrame, technique: str, **options) -> DataFrame:
    """Re-balance by technique name."""
    if technique not in TECHNIQUES:
        raise ValueError(f"unknown technique: {technique}")
    return TECHNIQUES[technique](df, **options)


def _stratified(pool: DataFrame, stratum: str, row_id: str, size: int, salt) -> DataFrame:
    """``size`` rows spread equally over the strata, the division remainder from any unsampled row.

    Few strata are cut by their rows' hashes without a shuffle; of many, rows are ranked within their stratum by one
    shuffle, and nothing about a stratum reaches the driver.
    """
    known = pool.filter(F.col(stratum).isNotNull())
    counts = few_counts(known, stratum)
    if counts is None:
        sizes = known.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
        strata = sizes.count()
        each, rest = divmod(size, strata)
        n_taken = sizes.agg(F.sum(F.least(F.col("n"), F.lit(each)))).first()[0]
        ranked = group_rank(with_hash(known, row_id, salt), [stratum], ["_u", row_id], "_rank")
        taken = ranked.filter(F.col("_rank") <= each).drop("_u", "_rank")
    elif counts:
        each, rest = divmod(size, len(counts))
        taken = first_by_hash(pool, stratum, row_id, salt, {k: min(each, n) for k, n in counts.items()}, counts)
        n_taken = sum(min(each, n) for n in counts.values())
    else:
        return first_by_hash(pool.withColumn("_all", F.lit(0)), "_all", row_id, salt, {0: size}).drop("_all")
    if rest == 0 or n_taken >= size:
        return taken
    left = remaining_rows(pool, taken, row_id).withColumn("_all", F.lit(0))
    fill = first_by_hash(left, "_all", row_id, salt, {0: min(rest, size - n_taken)}).drop("_all")
    return taken.unionByName(fill.select(*taken.columns))


def balanced_sample(
    df: DataFrame, row_id: str, size: int = 10_000, fraud_share: float = 0.3, label: str = "is_fraud",
    fraud_type: str = "fraud_type", kind: str = "transaction_type", salt: int = 42,
) -> DataFrame:
    """A training sample with a fixed fraud share, spread over fraud types and transaction types."""
    fraud, normal = df.filter(F.col(label)), df.filter(~F.col(label))
    n_fraud = int(size * fraud_share)
    frauds = fraud if fraud.count() < n_fraud else _stratified(fraud, fraud_type, row_id, n_fraud, salt)
    normals = _stratified(normal, kind, row_id, size - n_fraud, salt)
    return shuffle_rows(frauds.unionByName(normals), row_id, salt)
