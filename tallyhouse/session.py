"""Session settings and the shared folder that long plans are cut at."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the result is then grouped by that key.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # What a Python worker gets at once, and holds: rows of arrays may have a megabyte each.
    "spark.sql.execution.arrow.maxBytesPerBatch": "32m",
    # Files of a query's shuffles go when it ends, not when the driver's collector finds its plan unused.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
# Copies are written once and read a few times; keys of hex digits pack to half with it.
CODEC = "zstd"


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on (UTC) and the skew handling raw joins rely on."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local path would be invisible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="tallyhouse-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tallyhouse/{label}-{uuid.uuid4().hex}"


# Paths that `materialize` wrote in each `released` block of this thread, the innermost last.
_copies: ContextVar[tuple[list[str], ...]] = ContextVar("copies", default=())


def _copy_path(spark: SparkSession, label: str) -> str:
    path = new_path(spark, label)
    if blocks := _copies.get():
        blocks[-1].append(path)
    return path


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` and survives lost executors, but stays
    columnar, so the passes that follow read only the columns they need. The copy stays
    until the `released` block around it ends; without one it stays for good. Readers
    unpack a row group at once: ``rows`` bounds it where rows are large.
    """
    path = _copy_path(df.sparkSession, label)
    limit = {"parquet.block.row.count.limit": rows} if rows else {}
    df.write.options(compression=CODEC, **limit).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, name: str) -> None:
    """Delete a folder in the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles deleted that nothing reads any more.

    Spark deletes them when the driver's collector finds their plans unused, which on a quiet
    driver may be long after a step is written; a job of several large steps asks for it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, every copy that `materialize` made inside; blocks in other threads
    are none of its business.

    Results that still read those copies must be written or collected before that.
    """
    copies: list[str] = []
    outer = _copies.set((*_copies.get(), copies))
    try:
        yield
    finally:
        _copies.reset(outer)
        for path in copies:
            delete(spark, path)


@contextmanager
def kept() -> Iterator[None]:
    """Copies made inside belong to the block around the innermost `released` one, whose end they
    outlive; where there is none, they stay."""
    inner = _copies.set(_copies.get()[:-1])
    try:
        yield
    finally:
        _copies.reset(inner)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """`materialize` of what ``make`` returns; copies that are made on the way go at once."""
    path = _copy_path(spark, label)
    with released(spark):
        make().write.option("compression", CODEC).parquet(path)
    return spark.read.parquet(path)


def in_passes(rows: DataFrame, key: str, number: int, run: Callable[[DataFrame], DataFrame],
              label: str) -> DataFrame:
    """``run`` of the rows of each pass, by a hash of their ``key``, written before the next pass."""
    spark, done = rows.sparkSession, []
    for i in range(number):
        mine = rows if number == 1 else rows.filter(F.pmod(F.xxhash64(F.lit(number), key), F.lit(number)) == i)
        done.append(settled(spark, lambda: run(mine), label))
        forget_shuffles(spark)
    return reduce(DataFrame.unionByName, done)


def spread(scan: DataFrame) -> DataFrame:
    """Share a scan with fewer splits than cores out over all of them.

    Such a scan holds at most one split (``spark.sql.files.maxPartitionBytes``) per
    core, so the exchange is small whatever the cluster; larger scans stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
