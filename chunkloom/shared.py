"""Tables below the folder that executors share; never cached in executors, so a lost one costs only its tasks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, if it isn't installed."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode only, a temporary folder."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="chunkloom-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return "file://" + _OWN[0]


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """df as a Parquet table of its own: what is read later no longer depends on how it was made."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table that is read by fewer tasks than there are cores, because its files are few and small, dealt out to all of them; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def numbered(df: DataFrame, keys: list[str], name: str = "row") -> tuple[DataFrame, int]:
    """df with the rows' numbers 0, 1, ... in the order of keys, and how many there are.

    A range partitioning and one line a partition; no window over all rows.
    """
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    table = written(spread, "numbered")
    pid, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in table.groupBy(pid.alias("p")).count().collect())
    total, begin = 0, []
    for p, n in counts:
        begin.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(begin or [(0, 0)], "_p long, _begin long")
    return table.join(F.broadcast(offsets), pid == F.col("_p")).select(*[c for c in df.columns], (F.col("_begin") + inside).alias(name)), total
