"""Registry of queries: each operator on the benchmark tables, with the same question as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFn
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under ``name`` with its SQL counterpart, if SQL can say it."""

    def register(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(run, sql)
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round for comparison across engines."""
    return df.withColumns({c: r(F.col(c), digits) for c in columns})


# Two engines add doubles in different orders, so a value half-way between two roundings may
# go either way. Both sides are moved off the half-way points by the same small amount first.
def _nudge(digits: int) -> float:
    return 1.234 * 10.0 ** -(digits + 1)


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double") + F.lit(_nudge(digits)), digits) + F.lit(0.0)


def R(sql: str, digits: int = 6) -> str:
    """The SQL side of ``r``; adding zero turns -0.0 into 0.0."""
    return f"round(CAST({sql} AS DOUBLE) + {_nudge(digits)!r}::DOUBLE, {digits}) + 0.0"


def rand_sql(row_id: str, salt: str | int) -> str:
    return f"(CAST('0x' || substr(md5(CAST({row_id} AS VARCHAR) || ':{salt}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
