"""Write a table that several later steps read, and go on from the written copy."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from phasewise.functions import sizing

_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="phasewise-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame, kept: bool = False) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it from there.

    Readers prune its columns and share its scans, and a lost executor costs a re-read, not
    a re-run of what produced it. Inside ``scratch`` the copy goes when the block ends; a ``kept``
    one stays until the block around that one ends, if there is any.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    if len(_scopes) > kept:
        _scopes[-1 - kept].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_observed(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """The same with aggregates of its rows, taken while it is written: no job for them."""
    seen = Observation()
    return cut(df.observe(seen, *[c.alias(name) for name, c in sums.items()])), seen.get


def cut_bounded(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """The same, marked for broadcast if small; the bytes are summed while it is written."""
    written, seen = cut_observed(df, bytes=F.sum(sizing.row_bytes(df)))
    limit = sizing.MAX_BROADCAST_BYTES if max_bytes is None else max_bytes
    return F.broadcast(written) if (seen["bytes"] or 0) <= limit else written


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the copies written inside the block when it ends; what is needed later must be
    written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        configuration = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scopes.pop():
            place = hadoop(path)
            place.getFileSystem(configuration).delete(place, True)
