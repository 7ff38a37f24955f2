"""Helpers shared by the training-data operators: durable checkpoints, size-checked joins, digests."""

from __future__ import annotations

import os
import tempfile
import zipfile
import zlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most this many narrow rows.
BROADCAST_ROWS = 400_000


_shipped: set[str] = set()
_remembered: dict[tuple, object] = {}

#: Bytes of an Arrow batch, so that texts of any length take bounded memory on both sides.
BATCH_BYTES, ARROW_BYTES = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def remember(key: tuple, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task: one thing at a time, so stages don't add up their caches."""
    if key not in _remembered:
        _remembered.clear()
        _remembered[key] = make()
    return _remembered[key]


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of a cluster, once; workers of a local session find it by their path or working folder."""
    root = Path(__file__).resolve().parents[2]
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if context.applicationId in _shipped or is_local(spark) and (root in known or Path.cwd() == root):
        return
    _shipped.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="folio-code-")) / "foliospark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "foliospark").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))


def is_local(spark: SparkSession) -> bool:
    """Whether driver and workers are one machine."""
    return spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and cut its lineage there.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a local session gets a temporary
    folder, and a cluster is refused, as its executors share none. The copy survives lost executors.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="folio-checkpoint-"))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow, already materialised table for broadcast if it has at most ``limit`` rows.

    Beyond the limit it is left to a shuffled join, whose hot keys adaptive execution splits.
    """
    return F.broadcast(df) if df.count() <= limit else df


def crc_text(key: Column) -> Column:
    """crc32 of a key written as decimal text, as a long."""
    return F.crc32(key.cast("string").cast("binary"))


def held_out(key: Column) -> Column:
    """True for the fifth of rows that no model may learn from."""
    return F.coalesce(crc_text(key) % 5 == 0, F.lit(False))


def is_held_out(key: object) -> bool:
    """Python form of :func:`held_out`."""
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 0


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of the input can't clash with derived ones.

    Every operator starts here, so it also sees to the workers' code and, in a session that doesn't set it, to the size of
    Arrow batches; a size that the session sets itself is left alone.
    """
    ship(df.sparkSession)
    df.sparkSession.conf.set(ARROW_BYTES, df.sparkSession.conf.get(ARROW_BYTES, str(BATCH_BYTES)))
    return df.select(*[F.col(f"`{n}`") for n in names])
