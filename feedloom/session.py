"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the library is tuned for. They are ordinary session settings; a
# cluster's own values win when the session already exists.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Text aggregates hold whole strings: switch to the sort-based aggregate
    # early so that a task buffers one group at a time instead of many.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streams keep up to 60 days of ids: state on disk beside the executor instead of in its heap,
    # and checkpoints of what changed only.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# Settings inside :func:`scratch`, unless the session has its own.
SCRATCH_CONF = {
    # Texts take two thirds of what the default leaves. zstd is as small, but the buffers it takes outside of the
    # heap were not given back: an executor of 3000 MB passed its limit.
    "spark.sql.parquet.compression.codec": "gzip",
    "zlib.compress.level": "THREE",
    # Shuffle files go with the query that wrote them, not when the driver happens to collect its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def build_session(app: str = "feedloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would lose data with its machine.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="feedloom-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system and path object, as Spark itself resolves them."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


class Scratch:
    """Tables staged inside a block of :func:`scratch`."""

    def __init__(self, outer: Scratch | None):
        self.outer = outer
        self.paths: list[str] = []
        self.tables: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Let a table staged here last as long as the block around this one."""
        for path in [path for table, path in self.tables if table is df and path in self.paths]:
            self.paths.remove(path)
            if self.outer is not None:
                self.outer.paths.append(path)
                self.outer.tables.append((df, path))
        return df


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A block that leaves no files behind but those it writes itself.

    Tables staged inside are dropped when it ends, so nothing that reads them may leave it; see
    :meth:`Scratch.keep`. Shuffle files last as long as their query. Outside of such blocks staged tables
    stay until the shared folder's retention rule takes them.
    """
    own = {k: v for k, v in SCRATCH_CONF.items() if k not in spark.conf.getAll}
    for key, value in own.items():
        spark.conf.set(key, value)
    inner = Scratch(_scratch.get())
    token = _scratch.set(inner)
    try:
        yield inner
    finally:
        _scratch.reset(token)
        for key in own:
            spark.conf.unset(key)
        for path in inner.paths:
            files, location = filesystem(spark, path)
            files.delete(location, True)


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/feedloom-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and keeps column pruning and
    filter pushdown for whatever reads the staged table.
    """
    path = staging_path(df.sparkSession, label)
    block = _scratch.get()
    if block is not None:
        block.paths.append(path)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    if block is not None:
        block.tables.append((staged, path))
    return staged


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input that has fewer splits than cores.

    A file with a single row group is read by one task however large the
    cluster is. Inputs with enough splits are returned unchanged, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
