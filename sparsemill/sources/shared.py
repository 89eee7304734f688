"""The folder that the driver and all executors see, and tables in it."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder that is set on the context.

    Where neither is set, a temporary folder is set if Spark runs in this one process, as in tests; on a cluster this raises.
    """
    if held := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return held
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='sparsemill-')}")
    return spark.sparkContext.getCheckpointDir()


#: Folders of this process's tables, oldest first; and those that the innermost scope of this thread has made.
_tables: list[str] = []
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """Where a table of this process may lie in the shared folder; its folder goes when Python ends, at the latest."""
    folder = f"{shared_dir(spark)}/sparsemill-{uuid.uuid4().hex[:12]}"
    if not _tables:
        atexit.register(drop_tables, spark)
    _tables.append(folder)
    if (made := _scope.get()) is not None:
        made.append(folder)
    return f"{folder}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path.rpartition("/")[0]
    return out


def drop_tables(spark: SparkSession, folders: list[str] | None = None) -> None:
    """Delete these tables (all of this process's) in the shared folder; results that read them end with it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc
    with contextlib.suppress(Exception):  # the JVM may be gone before Python
        for folder in list(_tables if folders is None else folders):
            with contextlib.suppress(ValueError):  # another thread may have been faster
                _tables.remove(folder)
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables of `materialise` that nothing reads any more."""
    drop_tables(tables[0].sparkSession, [t._folder for t in tables])


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """A list of the folders that this thread's work makes from here on: what one run may delete without touching another's."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield made
    finally:
        _scope.reset(token)
