"""Session settings the jobs rely on, and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SEGMENT_CONF = "spark.chronofid.segmentRows"
SEGMENT_ROWS = 4_000_000
MAX_SEGMENTS = 100_000


def settings(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings every job expects: UTC clocks and adaptive execution."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )


def segment_rows(spark: SparkSession) -> int:
    """Rows one ordered group may bring to one task before it is split."""
    return int(spark.conf.get(SEGMENT_CONF, str(SEGMENT_ROWS)))


def _ensure_checkpoint_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="chronofid-")
    context.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there.

    The folder comes from ``spark.checkpoint.dir``. Only a local session may fall back to a
    temporary folder, since on a cluster that would live on one machine.
    """
    _ensure_checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below the shared checkpoint folder, for files that are written and read back."""
    _ensure_checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
