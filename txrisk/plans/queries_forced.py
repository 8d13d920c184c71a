"""Queries again with the limits so low that every group is split; the answers may not depend on them.

Which way an operator goes is decided while its plan is built, so the settings hold for that time only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txrisk.operators.velocity import RANGE_FRAME_ROWS_CONF
from txrisk.plans import queries_analysis, queries_features, queries_models  # noqa: F401  (register)
from txrisk.plans.registry import QUERIES, QueryFn, query
from txrisk.session import MAX_BROADCAST_BYTES_CONF, MAX_GROUP_ROWS_CONF, PART_ROWS_CONF, settings

#: Accounts of the benchmark table have some 70 rows.
_GROUPS = {MAX_GROUP_ROWS_CONF: 60, PART_ROWS_CONF: 500}
_ORDERS = {MAX_GROUP_ROWS_CONF: 500, PART_ROWS_CONF: 500}

SPLIT = {
    "account_history": _GROUPS,
    "entity_time_diff": _GROUPS,
    "history_features": _GROUPS,
    "velocity_features": _GROUPS | {RANGE_FRAME_ROWS_CONF: 5},
    "split_by_account": _GROUPS,
    "roc_curve": _ORDERS,
    "roc_auc": _ORDERS,
    "pr_curve": _ORDERS,
    "average_precision": _ORDERS,
    "best_f1_threshold": _ORDERS,
    "ks_drift": _ORDERS,
    "describe_numeric": _ORDERS,
    "boxplot_by_label": _ORDERS,
    "impute_median": _ORDERS,
    "knn_topk": {MAX_BROADCAST_BYTES_CONF: 0},
    "smote": {MAX_BROADCAST_BYTES_CONF: 0},
    "adasyn": {MAX_BROADCAST_BYTES_CONF: 0},
}


def _forced(run: QueryFn, values: dict) -> QueryFn:
    def forced(spark: SparkSession, sf_dir: str) -> DataFrame:
        with settings(spark, values):
            return run(spark, sf_dir)

    return forced


for _name, _values in SPLIT.items():
    query(f"{_name}_split", QUERIES[_name].sql)(_forced(QUERIES[_name].run, _values))
