"""Session settings for local runs; on a cluster the submitted settings win."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cpus}]").appName("linkloom")
            .config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.driver.memory", os.environ.get("LINKLOOM_DRIVER_MEMORY", "12g"))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, whatever folder the driver runs in."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="linkloom-"), "linkloom"), "zip", root, "linkloom")
        spark.sparkContext.addPyFile(name)
        _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor reaches: the one the cluster names; a private one only where none is set
    (tests, local runs)."""
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if shared is None and not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="linkloom-checkpoint-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


_STAGED: ContextVar[list[tuple[str, DataFrame]] | None] = ContextVar("staged", default=None)


def stage(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    Stage boundaries keep plans short (later stages use a table several times), survive lost executors
    and leave a columnar table, so the next stage reads only the columns it needs.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    made = _STAGED.get()
    if made is not None:
        made.append((path, staged))
    return staged


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark can reach it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def only_result(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions that build one table: the result is staged, and all tables staged on the way are deleted.

    The result reads nothing but its own table; nothing else that the function built may be used after it returns.
    """
    @wraps(build)
    def run(*args, **kwargs) -> DataFrame:
        outer, made = _STAGED.get(), []
        _STAGED.set(made)
        try:
            built = build(*args, **kwargs)
            kept = built if any(built is df for _, df in made) else stage(built)
        except BaseException:
            kept = None
            raise
        finally:
            _STAGED.set(outer)
            for path, df in made:
                if df is not kept:
                    delete_folder(df.sparkSession, path)
                elif outer is not None:
                    outer.append((path, df))
        return kept
    return run
