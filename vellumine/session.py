"""Session helpers: a local session for tests, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle: int = 8, app: str = "vellumine") -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where it is unset a local session (tests) sets a folder of its own; on a cluster that is an error, for a folder of one
    machine would be read short by the others.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    set_ = sc._jsc.sc().getCheckpointDir()
    if not set_.isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vellumine-ckpt-"))
        set_ = sc._jsc.sc().getCheckpointDir()
    return set_.get()


_WRITTEN: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df: a table written to the shared folder and read again, so a lost executor loses nothing.

    Columnar and compressed, so later readers take only the columns they use and the optimizer knows its size. The table
    stays until drop_cuts().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellumine-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts() -> int:
    """Delete every table cut() has written in this process, once the results that read them are stored; their number."""
    n = len(_WRITTEN)
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        if spark.sparkContext._jsc is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return n


def small(table: DataFrame, most: int = 8 << 20) -> DataFrame:
    """A table made by cut(), to be broadcast if its files hold no more than ``most`` bytes, else left to the optimizer."""
    spark = table.sparkSession
    size = 0
    for f in table.inputFiles():
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        size += p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
        if size > most:
            return table
    return F.broadcast(table)


def spread(df: DataFrame) -> DataFrame:
    """df as one side of a join that sorts both: never broadcast, whatever the optimizer takes its size to be.

    The size of a compressed table says little of its rows in memory, and nothing of what explode() makes of them.
    """
    return df.hint("merge")
