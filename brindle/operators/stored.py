"""Intermediate tables on storage that all executors share, and bounded Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of an Arrow batch, whichever is reached first.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def written(frame: DataFrame, label: str) -> DataFrame:
    """A frame written as Parquet in ``spark.checkpoint.dir`` and read back (on a local master
    without one, in a temporary folder). The driver then collects its garbage, so that the
    shuffles before leave the disks."""
    spark = frame.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    gc.collect()
    spark._jvm.java.lang.System.gc()
    return spark.read.schema(frame.schema).parquet(path)


def small_batches(frame: DataFrame) -> DataFrame:
    """Bounds the session's Arrow batches; smaller bounds are kept. The frame as it is."""
    conf = frame.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)b?", conf.get(key))
        if now is None or not 0 < int(now[1]) <= most:
            conf.set(key, str(most))
    return frame


Batches = Iterator[pa.RecordBatch]


def thrifty(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """An Arrow function that returns what its task no longer uses to the system: workers are
    kept from stage to stage."""

    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return whole
