"""Session helpers: sensible defaults for tests, and a durable place to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def local_session(cores: str = "8", app: str = "ratiowatch") -> SparkSession:
    """A session for tests and the benchmark. A cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RATIOWATCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only one-machine sessions may do without one.

    Executors on other machines cannot see a temporary folder of the driver, so a cluster
    that names no folder is an error, never a silent fall-back.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-ratiowatch-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; removed by ``drop_scratch`` or when the session's process ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def cut_lineage(frame: DataFrame, codec: str | None = None) -> DataFrame:
    """Write the rows once to the shared folder and read them back.

    A lost executor then never changes what later steps see, and several passes read a
    columnar table instead of repeating the work above it.
    """
    path = scratch_path(frame.sparkSession)
    writer = frame.write.option("compression", codec) if codec else frame.write
    writer.parquet(path)
    table = frame.sparkSession.read.schema(frame.schema).parquet(path)
    table._scratch = path
    return table


def drop_scratch(*tables: DataFrame) -> None:
    """Remove the files behind tables of ``cut_lineage``; without arguments, of all that are left."""
    paths = [t._scratch for t in tables] if tables else list(_WRITTEN)
    for path in paths:
        spark = _WRITTEN.pop(path, None)
        if spark is not None and spark.sparkContext._jsc is not None:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        drop_scratch()
