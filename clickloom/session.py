"""Session settings and the shared folder used for checkpoints and stream state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_HOT_ROWS = 5_000_000
DEFAULT_PAIR_BLOCK = 2_000
DEFAULT_SCAN_BYTES = 256 << 20


def build_session(app_name: str = "clickloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def hot_rows(spark: SparkSession) -> int:
    """Rows of one key above which that key is split over several tasks."""
    return int(spark.conf.get("spark.clickloom.hotRows", str(DEFAULT_HOT_ROWS)))


def scan_bytes(spark: SparkSession) -> int:
    """Bytes of input above which an ordered scan is dealt by ranges instead of by key."""
    return int(spark.conf.get("spark.clickloom.scanBytes", str(DEFAULT_SCAN_BYTES)))


def input_bytes(df: DataFrame) -> int:
    """Size of all tables behind the rows as Spark's planner knows it; without statistics it counts as huge. No job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def pair_block(spark: SparkSession) -> int:
    """Members of one group that meet in one task when pairs are formed."""
    return int(spark.conf.get("spark.clickloom.pairBlock", str(DEFAULT_PAIR_BLOCK)))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder stands in only for a local master without that setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="clickloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new sub-folder of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
