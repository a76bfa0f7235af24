"""Session settings for local work; a cluster brings its own session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "fathomline") -> SparkSession:
    """A local UTC session with adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def read(spark: SparkSession, sf_dir: str, name: str):
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a small table that a task takes at least while there are too few tasks for all cores, and at most beyond that.
FEWEST_ROWS, MOST_ROWS = 2_000, 25_000


def spread(df):
    """The rows of a compact table dealt out for work that grows with rows, not bytes: a file of a few megabytes is one split, whatever is made of its rows."""
    rows = df.count()
    return df.repartition(max(1, min(-(-rows // FEWEST_ROWS), max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // MOST_ROWS)))))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that driver and executors share, as spark.checkpoint.dir names it; a session on one machine may go without one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fathomline-")
        context.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def checkpointed(df):
    """df with its lineage cut in the shared folder that the session names; a session on one machine may go without one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="fathomline-"))
    return df.checkpoint()
