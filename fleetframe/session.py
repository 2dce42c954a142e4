"""Session settings and the reliable checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR_KEY = "spark.checkpoint.dir"


# Shuffle data one task should handle.
TASK_BYTES = 256 * 1024 * 1024


def build_session(
    app_name: str = "fleetframe",
    master: str | None = None,
    largest_shuffle_bytes: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with adaptive execution and skew-join splitting switched on.

    On a cluster leave ``master`` unset (spark-submit supplies it) and give
    ``spark.checkpoint.dir`` a folder that every executor can reach. From
    ``largest_shuffle_bytes`` the number of shuffle partitions is set so that a
    task handles about TASK_BYTES; smaller shuffles are merged at run time.
    Further settings are keywords, with ``__`` for a dot.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if largest_shuffle_bytes:
        partitions = str(max(1, -(-largest_shuffle_bytes // TASK_BYTES)))
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = partitions
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    That is enough for workers on this machine, whatever folder the driver was started in. Elsewhere
    the package comes with ``--py-files``, and the folder is passed over.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster such
    a folder would vanish with the machine, so the setting is required there.
    """
    reach_workers(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get(CHECKPOINT_DIR_KEY, None) or context.getConf().get(CHECKPOINT_DIR_KEY)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR_KEY} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="fleetframe-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and continue from the files.

    Used where one result feeds several branches of a plan, and between rounds
    of an iterative operator. The files outlive lost executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the checkpoint folder and read it back.

    For loops: a pinned frame keeps the estimated size of the plan it came from, and estimates of joins
    multiply from round to round, while a table has the size of its files. The files stay in the
    checkpoint folder until the ``scratch_tables`` block ends in which they were written.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, "table")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


# Folders of tables written by operators, in the order in which they were named.
_scratch: list[str] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append(folder)
    return folder


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, the tables that operators called in it wrote to the checkpoint folder.

    Frames are lazy, so results have to be written or collected within the block. Without a block the tables
    stay for as long as the checkpoint folder does.
    """
    first = len(_scratch)
    try:
        yield
    finally:
        configuration = spark.sparkContext._jsc.hadoopConfiguration()
        while len(_scratch) > first:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
            path.getFileSystem(configuration).delete(path, True)
