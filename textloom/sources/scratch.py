"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Has Spark delete the shuffle files of a query when it ends; a lost one is made again from its inputs.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder in local mode (tests), and an error on a cluster, whose executors would each write to a disk of their own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        shared = spark.sparkContext.getCheckpointDir()
    return shared


def scratch_path(spark: SparkSession, name: str = "stage") -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files behind."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def materialize(spark: SparkSession, df: DataFrame, *done: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage and survives lost executors. Then deletes `done`, materialised tables that nothing reads any more. `by`: columns that make folders, for readers of some of their values."""
    path = scratch_path(spark)
    with shuffles_freed(spark):
        df.write.partitionBy(*by).parquet(path)
    discard(spark, *done)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files of tables that materialize() returned."""
    for table in tables:
        path = _paths.pop(table, None)
        if path is not None:
            remove_files(spark, path)


def remove_files(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def hand_over(table: DataFrame, view: DataFrame) -> DataFrame:
    """Makes discard(view) delete the files of `table`, which `view` reads."""
    path = _paths.pop(table, None)
    if path is not None:
        _paths[view] = path
    return view
