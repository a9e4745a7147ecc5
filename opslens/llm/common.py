"""Helpers shared by the operators: tables, shared storage, bit filters, runs."""
from __future__ import annotations

import ctypes
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, the folder all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps
    start from the files, also after an executor is lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    relieve_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- the driver's memory ------------------------------------------------------

RELIEF_S = 5  # seconds between two reliefs, at least
RELIEF_SHARE = 0.05  # of the time that reliefs take, at most
_due = 0.0


def _trim_jvm(sc: SparkContext) -> str:
    """What jcmd calls System.trim_native_heap, asked for inside the driver's JVM:
    compilers and codecs free memory that the C library keeps. Returns its answer."""
    java = sc._jvm.java.lang
    beans = java.management.ManagementFactory.getPlatformMBeanServer()
    given = [sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None]
    names = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    types, values = (sc._gateway.new_array(kind, len(given)) for kind in (java.Class, java.Object))
    for i, (name, value) in enumerate(zip(names, given)):
        types[i], values[i] = java.Class.forName(name), value
    # through the interface: the class behind it is not open to callers
    return java.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(beans, values)


def relieve_driver(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage and give free memory back to the
    system, unless that was done just now.

    Plans of finished steps are garbage, which the JVM by itself keeps until its
    heap is full; what the compiler and the codecs have freed stays with the C
    library.  Broadcasts and shuffle files that only such plans name go, too.
    """
    global _due
    began = time.monotonic()
    if began < _due:
        return
    try:
        sc = spark.sparkContext
        sc._jvm.System.gc()
        _trim_jvm(sc)
    except Exception:  # Spark Connect has no JVM here; other JVMs may not know the command
        pass
    now = time.monotonic()
    _due = now + max(RELIEF_S, (now - began) / RELIEF_SHARE)


# --- Python on the executors ------------------------------------------------

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors once per application (addPyFile), so
    that their Python workers can import it wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(package)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def release_memory() -> None:
    """Give memory that Arrow and the C library keep for later use back to the
    system.  Python workers live on between tasks, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # GNU systems have it
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the Python workers, which
    keep no freed memory after a task."""
    ship_package(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release_memory()

    return df.mapInArrow(task, schema)


# --- fixed-size membership filters ------------------------------------------

def bit_filter(keys: DataFrame, column: str, log2_bits: int) -> np.ndarray:
    """Bit array of ``2**log2_bits`` bits with the low bits of every key set.

    Its size never depends on the data (at most ``2**log2_bits / 64`` longs
    reach the driver).  A fuller filter lets more non-members through, which
    costs later shuffling but never a result: callers join exactly afterwards.
    """
    slot = F.col(column).bitwiseAND((1 << log2_bits) - 1)
    words = (
        keys.where(F.col(column).isNotNull())
        .select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(63).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (log2_bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def slot_bits(n: int, most: int = 27) -> int:
    """log2 of the bits of a filter for n keys: 16 bits a key, up to a limit."""
    return min(most, max(16, int(16 * n).bit_length()))


def in_filter(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Boolean mask: which of the (uint64) values may be members."""
    slot = values & np.uint64(len(bits) * 64 - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


# --- Arrow batches ----------------------------------------------------------

def longs(column: pa.Array) -> np.ndarray:
    """A non-null long column as int64."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal (non-null) keys, each as one table.

    The input is a partition sorted by the keys; only the current run is held.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [longs(batch.column(k)) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for lo, hi in zip(starts, starts[1:]):
            key = tuple(int(c[lo]) for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
