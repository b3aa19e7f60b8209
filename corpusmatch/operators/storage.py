"""Where intermediate results are written so that no lineage has to be recomputed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for cut lineage.

    Only a session whose executors are threads of the driver gets a folder of its own where none is set;
    that one is removed when Python ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="corpusmatch-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def new_folder(spark: SparkSession) -> str:
    """A folder in the shared one that goes when the session's process ends in good order."""
    folder = f"{shared_dir(spark)}/corpusmatch/{uuid.uuid4().hex}"
    system, path = _at(spark, folder)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """A folder of its own in the shared folder, removed with all that was written to it at the end."""
    folder = new_folder(spark)
    try:
        yield folder
    finally:
        system, path = _at(spark, folder)
        system.delete(path, True)


# What Python gets at a time in costly steps: a worker holds a batch, copies of it and what is made of it.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304b"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most 1,000 rows and 4 MB (or one row) in what is run meanwhile; the settings return afterwards."""
    before = {key: spark.conf.get(key, None) for key in SMALL_BATCHES}
    try:
        for key, value in SMALL_BATCHES.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back with pruning intact.

    A lost executor then costs a read, not the work behind it. What goes to a ``staging`` folder lives
    as long as that; without a folder it stays as long as the session's process.
    """
    spark = df.sparkSession
    path = f"{folder or new_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
