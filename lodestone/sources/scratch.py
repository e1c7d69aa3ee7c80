"""Tables that a plan writes on its way, in the shared folder that the cluster names in spark.checkpoint.dir.

All of an application's tables stand below one folder of its own, which clear() deletes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table for each core up to which its rows may all stand in one split.
SPLIT = 4 << 20
#: Rows of a table that a join may broadcast.
BROADCAST_ROWS = 50_000
#: Folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The application's folder. A local session without a checkpoint folder gets a temporary one; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/lodestone-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that has been written: it is computed once, however often it is read."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if its scan is too small to be split for them; a table of more than SPLIT bytes a core stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT else df


def small(df: DataFrame) -> DataFrame:
    """df to be broadcast in a join, if it was counted to have BROADCAST_ROWS at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def clear(spark: SparkSession) -> None:
    """Delete the application's tables; nothing may read them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
