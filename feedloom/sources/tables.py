"""Stored tables: full refresh, week-partitioned merge, JSON export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.operators.incremental import merge_incremental, one_per_key, replaced_keys
from feedloom.session import filesystem


# Folder in which Spark keeps the rows without a partition value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    files, location = filesystem(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(location)] if files.exists(location) else []


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The stored table, or None when nothing has been written yet.

    With ``schema`` older files are read in that schema: columns they lack are
    NULL and columns since dropped are not read.
    """
    files, location = filesystem(spark, path)
    if not files.exists(location):
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_full(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the table. ``df`` must not read from ``path``."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """Result rows as JSON lines, NULL fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def partition_values(df: DataFrame, col: str) -> list:
    """Distinct partition values; as many as the table has weeks."""
    return [row[0] for row in df.select(col).distinct().collect()]


def touched_partitions(incoming: DataFrame, replaced: DataFrame, partition: str, also: Sequence = ()) -> tuple[list, Column]:
    """Values of the partitions that a merge changes, and whether a row lies in one of them.

    A partition changes if it receives rows, holds a row that is ``replaced`` or is named by ``also``.
    """
    found = partition_values(incoming.select(partition).union(replaced.select(partition)), partition)
    touched = list(dict.fromkeys([*found, *also]))
    inside = F.col(partition).isin([v for v in touched if v is not None])
    return touched, inside | F.col(partition).isNull() if None in touched else inside


def merge_partitions(
    spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], partition: str
) -> None:
    """Merge rows by key and rewrite only the partitions that change, in place.

    ``incoming`` is read several times, so it should come from a stored table.
    """
    existing = read_table(spark, path, incoming.schema)
    if existing is None:
        one_per_key(incoming, keys).write.partitionBy(partition).parquet(path)
        return
    touched, inside = touched_partitions(incoming, replaced_keys(existing, incoming, keys, partition), partition)
    if touched:
        replace_partitions(merge_incremental(existing.filter(inside), incoming, keys), path, partition, touched)


def replace_partitions(rows: DataFrame, path: str, partition: str, touched: list) -> None:
    """Write ``rows`` over the ``touched`` partitions, emptied ones included.

    ``rows`` may read those partitions: a dynamic overwrite writes next to the
    table and moves partitions into place when all tasks are done.
    """
    left = partition_values(rows, partition)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    # Dynamic overwrite keeps a partition that gets no rows.
    for value in set(touched) - set(left):
        value = NO_VALUE if value is None else value
        files, folder = filesystem(rows.sparkSession, f"{path}/{partition}={value}")
        files.delete(folder, True)
