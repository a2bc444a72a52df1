"""Reading tables and cutting lineage, in one place."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_STAGES = "maskweave-stage"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Partitions for a stage that computes much: those of shuffles, but at least one for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` partitioned by its keys, with a fixed number of partitions.

    What is derived from it and grouped or joined by these keys (and others)
    needs no further shuffle.  The number is fixed since the size of a text says
    little about the work that patterns make of it.
    """
    return df.repartition(partitions(df.sparkSession), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` as it is if its scan makes at least as many partitions as there are cores, else partitioned by its keys.

    Told by the size that the planner estimates, so nothing is run and no file
    names come to the driver.
    """
    spark = df.sparkSession
    if df.isStreaming:
        return df
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= split * spark.sparkContext.defaultParallelism else by_key(df, *keys)


def shuffled(left: DataFrame, right: DataFrame, on: str | list[str] | Column | list[Column], how: str = "inner") -> DataFrame:
    """A join by shuffles, never by a broadcast.

    For sides that are unfolded, or read from staged tables: the planner knows
    the compressed files' size only, and what it takes for small can be many
    times that in the driver's memory.
    """
    return left.join(right.hint("merge"), on, how)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one that ``spark.checkpoint.dir`` (or an earlier
    ``setCheckpointDir``) names.  Only where neither is set, as in tests on one
    machine, a folder of our own is made and set; a cluster without the setting
    is refused, since a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="maskweave-")
    sc.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    This cuts the lineage reliably: the table survives the loss of executors,
    is compressed, and keeps column pruning and filter pushdown.  ``unstaged``
    removes it; what is left is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/{_STAGES}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(root)
    out = spark.read.schema(df.schema).parquet(root)
    _roots[root] = spark
    out._staged_root = root  # for unstaged
    return out


#: Folders of staged tables that are still there, with their sessions.
_roots: dict[str, SparkSession] = {}


def _remove(root: str) -> None:
    spark = _roots.pop(root, None)
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the shared folder's owner cleans up
        pass


def unstaged(*tables: DataFrame | None) -> None:
    """Remove staged tables whose successors have been written, so that rounds don't fill the disk.

    Frames that ``staged`` didn't make, and those removed before, are passed over.
    """
    for t in tables:
        root = getattr(t, "_staged_root", None)
        if root in _roots:
            _remove(root)


@atexit.register
def _forget() -> None:
    for root in list(_roots):
        _remove(root)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, stage: str = "ranked") -> DataFrame:
    """Adds ``name``, the number from 1 of each row among those of equal keys, in the order of the columns ``order``.

    Rows are cut into ranges of (keys, order), so a key that holds a third of
    all rows is spread over a third of the ranges.  A row's number is that of
    the rows of its key in earlier ranges, plus its own inside the range.  The
    ranges are written to the shared folder, since both counts must see the same.
    The order must be one of whole values: ties may be numbered either way.
    """
    cut = df.repartitionByRange(partitions(df.sparkSession), *keys, *order)
    cut = staged(cut.withColumn("_range", F.spark_partition_id()), stage)
    sizes = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    held = F.sum("_n").over(W.partitionBy(*keys).orderBy("_range"))
    earlier = sizes.withColumn("_earlier", held - F.col("_n")).select(*[F.col(c).alias(f"_of_{c}") for c in [*keys, "_range"]], "_earlier")
    inside = cut.withColumn("_inside", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)))
    same: Column = F.lit(True)
    for c in [*keys, "_range"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return inside.join(earlier, same).select(*df.columns, (F.col("_earlier") + F.col("_inside")).cast("int").alias(name))
