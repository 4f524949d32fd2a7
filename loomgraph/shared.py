"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="spark-shared-")
    sc.setCheckpointDir(own)
    return "file://" + own


#: For each open ``scratch`` block of this thread or task, the tables stored in it.
_scratch: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch", default=())


def stored(df: DataFrame, name: str, keep: bool = False, dense: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives lost executors. With ``keep`` it outlives the innermost ``scratch`` block; ``dense`` packs texts tighter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    blocks = _scratch.get()[:-1] if keep else _scratch.get()
    if blocks:
        blocks[-1].append(path)
    (df.write.option("compression", "zstd") if dense else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables stored in this block when it ends; blocks of other threads are apart. What is read after it must be stored with ``keep``, for tables are read only when a result is."""
    own: list[str] = []
    token = _scratch.set((*_scratch.get(), own))
    try:
        yield
    finally:
        _scratch.reset(token)
        for name in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
