"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import io
import os
import uuid
import zipfile
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import basketry
from basketry.session import checkpoint_dir, materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a maximal run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's default bytes in a batch of rows for Python, and this package's: its
#: rows are whole texts, and a batch is held a few times over by each task.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each Spark context,
    so that functions of its modules can run there. It goes through the shared
    checkpoint folder, where an executor that starts later finds it too. A
    session that leaves the bytes of a batch at the default gets smaller ones."""
    key, default, own = BATCH
    if spark.conf.get(key, None) == default:
        spark.conf.set(key, own)
    sc = spark.sparkContext
    if getattr(sc, "_basketry_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(basketry.__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = f"{checkpoint_dir(spark).rstrip('/')}/basketry-{uuid.uuid4().hex}.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(path)
    sc._basketry_shipped = True


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Keep this worker's matrix products to one thread: an executor runs a task
    on each of its cores, and more threads only wait for each other."""
    try:
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:                             # another system
        return
    for path in paths:
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads",
                     "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)


def _then_trim(run):
    """``run`` on one thread, and after its last batch the task's freed memory
    goes back to the system: Python workers are used again and would keep it."""
    def task(batches):
        one_thread()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):       # another C library
            pass
    return task


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(_then_trim(run), schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Written tables cut lineage: ``table(df, name)``.
table = materialize


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays.

    For a pure ASCII text ``lower`` does just that, and fast; other texts go
    through ``translate``."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, LOWER))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of the named columns."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond
