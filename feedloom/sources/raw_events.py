"""Raw events: reading stored ones and appending new ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import schemas


def read_raw_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored raw events in any file format with named columns."""
    return spark.read.schema(schemas.RAW_SCHEMA).format(fmt).load(path)


def stream_raw_events(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """The same table as a stream of its files. ``path`` is a folder or a glob."""
    reader = spark.readStream.schema(schemas.RAW_SCHEMA).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def pack_json(*cols: str | Column, keep_nulls: bool = False) -> Column:
    """The given columns as one JSON object."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": str(not keep_nulls).lower()})


def to_raw_events(
    df: DataFrame, ingest_ts: str | Column | None = None, id_cols: Sequence[str] | None = None
) -> DataFrame:
    """Payload rows as raw events: id, ingestion time, payload as JSON text.

    The id is a given column, or a hash of ``id_cols`` or of the whole payload,
    so that a replay gives the same ids. ``ingest_ts`` defaults to now.
    """
    at = F.current_timestamp() if ingest_ts is None else ingest_ts
    if isinstance(at, str):
        at = F.lit(at).cast("timestamp")
    packed = df.withColumn("raw_event", pack_json(*df.columns))
    if id_cols is None:
        row_id = F.xxhash64("raw_event")
    elif len(id_cols) == 1 and df.schema[id_cols[0]].dataType.typeName() in ("integer", "long"):
        row_id = F.col(id_cols[0]).cast("long")
    else:
        row_id = F.xxhash64(*id_cols)
    return packed.select(row_id.alias("id"), at.alias("event_time"), "raw_event")


def append_raw_events(raw: DataFrame, path: str, fmt: str = "parquet") -> None:
    raw.write.format(fmt).mode("append").save(path)
