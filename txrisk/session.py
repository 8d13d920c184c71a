"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime settings only: nothing here sizes a cluster. AQE picks the number of
# reduce partitions, splits skewed join partitions and switches join strategies.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

#: Largest group one task may hold before an operator splits it.
MAX_GROUP_ROWS_CONF = "spark.txrisk.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 2_000_000
#: Rows of one part of a split group; an eighth of the limit unless set, so that a group just above the limit keeps
#: several tasks busy.
PART_ROWS_CONF = "spark.txrisk.partRows"
#: Largest table (in bytes, estimated from rows x width) an operator broadcasts.
MAX_BROADCAST_BYTES_CONF = "spark.txrisk.maxBroadcastBytes"
DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("txrisk")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_GROUP_ROWS_CONF, str(DEFAULT_MAX_GROUP_ROWS)))


def part_rows(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get(PART_ROWS_CONF, str(math.ceil(max_group_rows(spark) / 8)))))


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Session settings for the time of a block; what the caller had set comes back."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def max_broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_BROADCAST_BYTES_CONF, str(DEFAULT_MAX_BROADCAST_BYTES)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and hand-off tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder: on a cluster that would be one machine's.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="txrisk-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
