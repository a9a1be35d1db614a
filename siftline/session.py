"""Shared folder for checkpoints and written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
import zipfile
from contextlib import suppress
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    It is set here only where the session names none, which is allowed on a plain local
    master alone: a cluster, ``local-cluster`` included, must name a folder that every
    executor reaches.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    folder = context.getCheckpointDir()
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="siftline-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def ensure_checkpointing(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` and tree-model checkpoints usable."""
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)


_HELD: set[str] = set()


def _work_folder(spark: SparkSession) -> str:
    """The application's own folder below the shared one; it goes when the driver's Python ends."""
    folder = f"{shared_folder(spark)}/siftline/{spark.sparkContext.applicationId}"
    if folder not in _HELD:
        _HELD.add(folder)
        atexit.register(_discard_quietly, spark, folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses, deleted at the end of the application."""
    return f"{_work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate table on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _discard_quietly(spark: SparkSession, path: str) -> None:
    with suppress(Py4JError, OSError, AttributeError):  # the session may be gone by then
        discard(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back: it survives lost executors and cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` has returned and nothing reads any more."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        discard(df.sparkSession, path)


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()  # fits of a search run in threads of one driver


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once for an application.

    They import it by name, but only the driver is known to have it on its path.
    """
    context = spark.sparkContext
    with _SHIPPING:
        if context.applicationId in _SHIPPED:
            return
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="siftline-")) / "siftline.zip"
        with zipfile.ZipFile(archive, "w") as packed:
            for file in sorted(package.rglob("*.py")):
                packed.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))  # Spark hands it out from the driver
        _SHIPPED.add(context.applicationId)
