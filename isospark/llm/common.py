"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a folder within the warehouse is taken, on one
    machine only; on a cluster that folder may be local to each machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    This cuts lineage durably (any executor may be lost afterwards), gives the
    optimizer real sizes, and computes df once for several readers.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/isospark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a cut that nothing reads any more (a superseded iteration)."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_bytes(array: pa.Array, step: int = 256):
    """The rows of a string array as bytes or None, a few rows in memory at a time."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    for k in range(0, len(array), step):
        yield from array.slice(k, step).cast(kind).to_pylist()


#: What a Python worker keeps between tasks: states of the operator that ran last.
_state: dict = {}


def worker_state(key: tuple, make, kept: int = 1):
    """make(), or what it gave before if this worker still keeps it: up to `kept` states of one operator (key[0]), and no other's."""
    if key not in _state:
        if len(_state) >= kept or any(k[0] != key[0] for k in _state):
            release()
        _state[key] = make()
    return _state[key]


def release() -> None:
    """Gives a worker's kept state and unused memory back, before another operator needs room."""
    _state.clear()
    settle()


def settle() -> None:
    """Gives unused memory back to the system: Arrow's, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
