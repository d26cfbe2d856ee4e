"""Tables in the folder that the driver and all executors share, and how tables are dealt out and joined by measured size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders made for local sessions that name no shared folder, by application id.
_LOCAL_ROOTS: dict[str, str] = {}
#: Most rows of a few plain columns that are broadcast (about 50 MB as a hash table); more are joined by a shuffle.
MAX_BROADCAST = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share: ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a temporary folder; a cluster without it is an error, since a
    machine-local folder would not be seen by other machines.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[sc.applicationId] = tempfile.mkdtemp(prefix="queryscope-")
        root = _LOCAL_ROOTS[sc.applicationId]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return f"file://{root}" if root.startswith("/") else root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts lineage, survives the loss of executors, reads only the columns asked for."""
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sendable(rows: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """``rows`` (a stored table of a few plain columns), marked for broadcast if its counted size allows it."""
    return F.broadcast(rows) if rows.count() <= most else rows


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table of few file splits to all cores; one with enough splits stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``df`` with the place (1, 2, …) of each row in a total ``order``, without gathering the rows in one task.

    Rows are sorted in ranges and written; places are those within a range plus the counts of the ranges before, of which
    there is one row each.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    rows = stored(sorted_.withColumn("_range", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    return rows.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")  # a row for each range
