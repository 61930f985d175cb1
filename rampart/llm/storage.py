"""Tables written to the folder that all executors share, to cut lineage and to run a costly step once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows in one exchange with a Python worker. Documents are long, so the usual 10,000 rows would be too many.
BATCH = "4m"
#: Rows of a few numbers up to which a side of a join is broadcast; they take some tens of megabytes.
BROADCAST_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where that is unset and all runs in one machine, a new folder of
    that machine becomes it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rampart-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound what Python workers get at once, in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a reader of it.

    A lost executor costs a re-read of these files, never a re-run of what made them.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rampart_path = path
    return out


def placed(df: DataFrame, label: str) -> DataFrame:
    """``df``, of rows of a few numbers, written; broadcast in joins if the rows, counted, are few. If not, a join with it
    is one of plain shuffles, whose large partitions Spark splits."""
    df = materialize(df, label)
    if df.count() > BROADCAST_ROWS:  # the files know
        return df
    small = F.broadcast(df)
    small._rampart_path = df._rampart_path
    return small


def is_broadcast(df: DataFrame) -> bool:
    """Whether ``placed`` found the table small."""
    return df.count() <= BROADCAST_ROWS


def partitions(df: DataFrame, size: int = 256 << 20) -> int:
    """Shuffle partitions for the rows of ``df``: the session's number, or more if its files are so large that a
    partition would exceed ``size`` bytes."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-known // size)) if known < 1 << 60 else least  # what Spark can't tell has the size of a long


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that no later plan reads. Others are left alone."""
    for df in tables:
        path = getattr(df, "__dict__", {}).get("_rampart_path")
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
