"""Streaming sources and the JSON envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.schema import STREAM_RECORD


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType = STREAM_RECORD, files_per_trigger: int = 1
) -> DataFrame:
    """JSON files dropped into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def kafka_options(servers: str, topic: str = "transactions", offsets: str = "latest") -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": offsets}


def stream_kafka(
    spark: SparkSession, servers: str, topic: str = "transactions", offsets: str = "latest",
    schema: T.StructType = STREAM_RECORD,
) -> DataFrame:
    """A topic of JSON values. Needs the Kafka connector on the session's class path."""
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, topic, offsets)).load()
    return parse_json(raw.select(F.col("value").cast("string").alias("value")), schema)


def socket_options(host: str = "localhost", port: int = 9999) -> dict[str, str]:
    return {"host": host, "port": str(port)}


def stream_socket(
    spark: SparkSession, host: str = "localhost", port: int = 9999, schema: T.StructType = STREAM_RECORD
) -> DataFrame:
    """JSON lines from a socket: for trying things out, it cannot replay."""
    raw = spark.readStream.format("socket").options(**socket_options(host, port)).load()
    return parse_json(raw, schema)


def parse_json(lines: DataFrame, schema: T.StructType = STREAM_RECORD, column: str = "value") -> DataFrame:
    """One record per line; what does not parse becomes a row of NULLs."""
    return lines.select(F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}).alias("_data")).select("_data.*")


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rows without a single value)."""
    anything = F.coalesce(*[F.col(c).cast("string") for c in parsed.columns]).isNotNull()
    return parsed.filter(anything), parsed.filter(~anything)
