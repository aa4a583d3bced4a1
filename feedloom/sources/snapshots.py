"""Versions of a set of tables: immutable folders, and a manifest that names those of each version."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from feedloom.sources.tables import NO_VALUE, children, filesystem


class Conflict(RuntimeError):
    """Another run has published the version first."""


class Snapshots:
    """Tables under ``root``, published together.

    A run writes what it changes into folders of its own, ``data/<table>/run=<id>``, and never
    touches a folder that is there. The manifest of a version, a small file in ``versions``,
    lists the folders that make up every table. It is written once, at the end, so a
    reader sees all tables of one version, whatever runs meanwhile, and a run that dies
    leaves the last version as it was.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def versions(self) -> list[int]:
        names = children(self.spark, f"{self.root}/versions")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int) -> dict[str, list[str]]:
        """Folders of every table in a version; version 0 has no tables."""
        if not version:
            return {}
        rows = self.spark.read.text(f"{self.root}/versions/{version:020d}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def publish(self, version: int, tables: dict[str, list[str]]) -> None:
        """Make ``tables`` the given version, in one step; fails if there is one already."""
        folder = f"{self.root}/versions"
        files, target = filesystem(self.spark, f"{folder}/{version:020d}.json")
        _, draft = filesystem(self.spark, f"{folder}/.{uuid.uuid4().hex}.draft")
        out = files.create(draft, False)
        out.write(json.dumps(tables, sort_keys=True).encode())
        out.close()
        if files.exists(target) or not files.rename(draft, target):
            files.delete(draft, False)
            raise Conflict(f"version {version} exists; refresh and run again")

    def write(self, name: str, rows: DataFrame, partition: str | None = None) -> list[str]:
        """Write rows into new folders, one for each partition value, and return their names."""
        run = f"run={uuid.uuid4().hex}"
        path = f"{self.root}/data/{name}/{run}"
        rows.write.partitionBy(*([partition] if partition else [])).parquet(path)
        if partition is None:
            return [run]
        return [f"{run}/{child}" for child in children(self.spark, path) if child.startswith(f"{partition}=")]

    def read(self, name: str, folders: list[str], schema: StructType) -> DataFrame:
        """The rows of these folders. Columns that older files lack are NULL, those since dropped are not read."""
        base = f"{self.root}/data/{name}"
        reader = self.spark.read.schema(schema).option("basePath", base)
        return reader.parquet(*[f"{base}/{f}" for f in folders]).select(*schema.names)

    def expire(self, keep: int = 10) -> None:
        """Drop all but the last ``keep`` versions, and the folders that only they name.

        Folders that no version names are left: a run may be writing them.
        """
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        used = {(name, f) for v in kept for name, folders in self.manifest(v).items() for f in folders}
        for version in old:
            gone = {(name, f) for name, folders in self.manifest(version).items() for f in folders} - used
            for name, folder in gone:
                files, location = filesystem(self.spark, f"{self.root}/data/{name}/{folder}")
                files.delete(location, True)
            files, location = filesystem(self.spark, f"{self.root}/versions/{version:020d}.json")
            files.delete(location, False)


def folder_of(partition: str, value) -> str:
    """Name of the folder of a partition value."""
    return f"{partition}={NO_VALUE if value is None else value}"
