"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.scratch import spread

#: Broadcast sides are counted first; beyond this many rows the join is left to a shuffle.
BROADCAST_ROWS = 50_000


#: Rows of an Arrow batch between the JVM and Python: some megabytes of documents, on either side.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, once its session hands rows to Python in batches of BATCH_ROWS at most; a table of a few megabytes is dealt over all cores."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return spread(df)


#: Folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without one (tests) gets a temporary one, a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        folder = _OWN[app]
    return folder


#: Tables that the open passing() blocks, the innermost last, have to drop.
_MADE: ContextVar[tuple[list, ...]] = ContextVar("made", default=())


@contextmanager
def passing() -> Iterator[None]:
    """Tables that written() makes inside are dropped at the end, whether it is reached or not.

    So nothing that is lazy may leave the block but what reads only tables of lasting().
    """
    made: list[DataFrame] = []
    token = _MADE.set((*_MADE.get(), made))
    try:
        yield
    finally:
        _MADE.reset(token)
        for t in made:
            drop(t)


def lasting(df: DataFrame, name: str) -> DataFrame:
    """written(), but the innermost open passing() leaves the table to the one around it."""
    token = _MADE.set(_MADE.get()[:-1])
    try:
        return written(df, name)
    finally:
        _MADE.reset(token)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    if open_ := _MADE.get():
        open_[-1].append(out)
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that written() made; whatever still reads it must have run."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """big joined to a table that is expected to be small; it is broadcast only if it was counted to have so many rows at most."""
    from pyspark.sql import functions as F

    if small.count() <= rows:
        small = F.broadcast(small)
    return big.join(small, on, how)
