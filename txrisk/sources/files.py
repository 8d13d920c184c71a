"""File sources and sinks."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.schema import TRANSACTION

FORMATS = ("parquet", "csv", "json")


#: Columns a table of transactions can't do without.
REQUIRED = ("transaction_id", "timestamp", "amount")


def _typed(name: str, kind: T.DataType) -> Column:
    """A text column in its type; null where the text doesn't say such a value."""
    text = F.trim(F.col(f"`{name}`"))
    if isinstance(kind, T.BooleanType):
        return F.when(F.lower(text).isin("true", "1", "1.0"), True).when(F.lower(text).isin("false", "0", "0.0"), False)
    return F.col(f"`{name}`") if isinstance(kind, T.StringType) else text.try_cast(kind)


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = TRANSACTION,
    infer: bool = False,
    required: Sequence[str] = REQUIRED,
) -> DataFrame:
    """CSV with a header. A given schema saves the inference pass over the whole input.

    Columns are found by name in the header, whatever their order there, and returned in the schema's order. A
    missing ``required`` column is an error, other missing ones are null; columns the schema lacks are left out.
    Boolean columns may be written true/false or 1/0.
    """
    reader = spark.read.option("header", True)
    if infer or schema is None:
        return reader.option("inferSchema", True).csv(path)
    texts = reader.csv(path)
    missing = [f.name for f in schema if f.name in required and f.name not in texts.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return texts.select(
        *[
            (_typed(f.name, f.dataType) if f.name in texts.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def _first_sign(spark: SparkSession, path: str) -> str:
    """The first character that is not white space, of a text file."""
    first = spark.read.text(path).filter(F.length(F.trim("value")) > 0).limit(1).collect()
    return first[0][0].lstrip()[:1] if first else ""


def _sniff(spark: SparkSession, path: str) -> str:
    """Format of files without a telling name: Parquet has a footer, JSON lines start with a brace."""
    try:
        spark.read.parquet(path).schema
        return "parquet"
    except (PySparkException, Py4JJavaError) as error:
        # Text files have no footer and give no schema; anything else is a real failure.
        if not any(mark in str(error) for mark in ("CANNOT_READ_FILE_FOOTER", "UNABLE_TO_INFER_SCHEMA", "not a Parquet file")):
            raise
    return "json" if _first_sign(spark, path) in ("{", "[") else "csv"


def format_of(path: str) -> str | None:
    suffix = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    return suffix if suffix in FORMATS else None


def scan_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """Read Parquet, CSV or JSON by name or by suffix; a folder of part files is one table."""
    if fmt is not None and fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    kind = fmt or format_of(path) or _sniff(spark, path)
    if kind == "csv":
        return scan_csv(spark, path, schema, infer=schema is None)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "json" and _first_sign(spark, path) == "[":
        reader = reader.option("multiLine", True)  # one array instead of a record per line
    return reader.format(kind).load(path)


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write as Parquet, CSV (with header) or JSON lines, one file per task."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def sink_parquet(df: DataFrame, path: str) -> None:
    sink_table(df, path, "parquet", "overwrite")


def metrics_table(spark: SparkSession, metrics: Mapping[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in metrics.items()], "metric string, value double")


def sink_metrics(metrics: DataFrame, path: str) -> None:
    """A (metric, value) table as JSON lines; it is a handful of rows, so one file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
