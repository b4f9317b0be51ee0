"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, whichever is reached first. Whole texts travel in them,
#: so the defaults would hold tens of MB a task several times over, in the JVM and in Python.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20

#: Rows (of an id and a digest) up to which a side is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 1_000_000


#: Folders written inside the open ``temporary`` blocks, innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` when the session
    names one, else the context's. Only on a local master (single-machine tests) a
    temporary folder is made where there is none; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named is None:
        named = context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoints-")
        context.setCheckpointDir(named)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what ``written`` wrote inside, so frames read from there must
    have been consumed or written elsewhere (``keep``) by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def checkpointed(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint of a small frame (loop state)."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back. Inside ``temporary``
    it is deleted at the block's end unless kept.

    Columnar and compressed, so it suits large intermediate tables better than
    a checkpoint does.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _open and not keep:
        _open[-1].append(path)
    frame.write.parquet(path)
    relieve(spark)
    return spark.read.schema(frame.schema).parquet(path)


def sized(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A join side of narrow rows, written once and counted: marked for broadcasting up
    to ``most`` rows, else left to a shuffle join. It spares large texts the shuffle."""
    side = written(side, "join-side")
    return F.broadcast(side) if side.count() <= most else side


def plain_columns(frame: DataFrame, *kept: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with all columns but ``kept`` under neutral names, so that no extra column
    clashes with an operator's own, and the way back to the original columns."""
    names = frame.columns
    inner = {c: f"_c{k}" for k, c in enumerate(names) if c not in kept}
    plain = frame.select(*[F.col(f"`{c}`").alias(inner.get(c, c)) for c in names])
    return plain, lambda out: out.select(*[F.col(inner.get(c, c)).alias(c) for c in names])


def small_batches(frame: DataFrame, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """Bounds the session's Arrow batches for functions over whole texts; the frame as it is.

    The settings are read when a plan runs, so they stay; smaller ones are kept.
    """
    conf = frame.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)b?", conf.get(key))
        if now is None or not 0 < int(now[1]) <= most:
            conf.set(key, str(most))
    return frame


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Returns the memory that nothing uses any more to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def relieve(spark: SparkSession) -> None:
    """Returns the memory that the driver no longer uses to the system, like ``give_back`` in a
    worker. Compiling and planning pass through the JVM's malloc, whose arenas keep what was
    freed, and a heap rather grows than collects: beyond half of its bound it is collected.
    A JVM without the command for malloc keeps what it has.
    """
    jvm, give = spark._jvm, spark.sparkContext._gateway.new_array
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > heap.maxMemory() // 2:
        jvm.java.lang.System.gc()
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # By the interface's method: the server's own class is not open to the gateway.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        command = give(jvm.java.lang.Object, 4)
        command[0], command[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, command)
    except Py4JError:
        pass
    give_back()


def thrifty(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """An Arrow function that gives back its arrays' memory at a task's end. Workers are kept
    from stage to stage, and allocators keep what was freed, so idle ones would add up."""

    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return whole
