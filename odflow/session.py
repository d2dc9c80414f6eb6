"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SALTS_CONF = "spark.odflow.salts"


def local_session(cores: str = "8", app: str = "odflow") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def salt_count(spark: SparkSession) -> int:
    """How many ways a lookup on a few hot keys is spread: the setting, else the shuffle width; a power of two."""
    wanted = int(spark.conf.get(SALTS_CONF, str(shuffle_width(spark))))
    return 1 << max(wanted - 1, 0).bit_length()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a scratch folder of its own: on a cluster an executor
    lost together with its disk would take the checkpoint with it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
    elif context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def materialise(frame: DataFrame) -> DataFrame:
    """Checkpoint the small state of a loop, so that a round's plan holds that round only."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def table_path(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


def write_table(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write the frame as a Parquet table in the shared folder and continue from the written copy.

    For tables that several later steps read: they prune columns, and joins know the true size, so the
    planner broadcasts a copy under its threshold and shuffles a larger one. ``by`` lays the table out by key, so that
    reads of one key prune the others.
    """
    path = table_path(frame.sparkSession)
    (frame.write.partitionBy(*by) if by else frame.write).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
