"""Relations of a database, graphs and matrices on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A table or query of a database, in parts by ranges of a numeric ``key``; an unknown table is an error, not an empty result."""
    if key is None or partitions <= 1:
        return spark.read.jdbc(url, table, properties=options)
    ends = spark.read.jdbc(url, f"(select min({key}) as low, max({key}) as high from {table}) ends", properties=options).first()
    low, high = (int(x) if x is not None else 0 for x in ends)
    return spark.read.jdbc(url, table, key, low, high + 1, partitions, properties=options)


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Rows are written in one connection a partition, each partition in one transaction."""
    df.write.jdbc(url, table, mode, options)


def save_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.parquet(f"{path}/vertices")
    edges.write.parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def save_matrix(entries: DataFrame, path: str) -> None:
    """A sparse matrix (i, j, value)."""
    entries.write.parquet(path)


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dense_matrix(lines: DataFrame, column: str = "value") -> DataFrame:
    """(i, j, value) of a text matrix of one row a line, numbers by blanks; ``lines`` has the line number as i. Zeros are left out."""
    cells = lines.select("i", F.posexplode(F.split(F.trim(F.col(column)), r"\s+")).alias("j", "cell"))
    return cells.select("i", "j", F.col("cell").try_cast("double").alias("value")).where("value <> 0")
