"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    Texts of one byte per character take the quick built-in; others are translated.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, the session's ``spark.checkpoint.dir``.

    Only where that is unset and all runs in this process (tests on one machine) a temporary one is made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.match(r"local(\[[^-]*\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp("-checkpoints"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint in the folder that all executors share."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner take away the shuffle files, and with ``spark.cleaner.referenceTracking.cleanCheckpoints`` the
    checkpoints, of tables that nothing refers to any more.

    The cleaner goes by what the driver's garbage collection finds, and a driver that does little may not collect for
    half an hour, while the tables of operators with many rounds stay on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes that a side may take to be sent to all executors, as its rows' text and numbers.
MOST_BROADCAST = 32 << 20


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` marked for a broadcast if a look at all its rows shows that they take at most ``most`` bytes; otherwise as
    it is, for a join by shuffle. ``df`` should be cheap to read twice."""
    return F.broadcast(df) if _taken(df) <= most else df


#: Bytes of a table that one task may work through at once without being the slow one.
MOST_AT_ONCE = 8 << 20


def gathered(df: DataFrame) -> DataFrame:
    """``df`` made durable; in one partition if a look at all its rows shows that they are few, so that joins and groups of
    it need no exchange."""
    made = durable(df)
    return made.coalesce(1) if is_few(made) else made


def is_few(df: DataFrame) -> bool:
    return _taken(df) <= MOST_AT_ONCE


def _taken(df: DataFrame) -> int:
    """About how many bytes all rows take."""
    row = reduce(lambda a, b: a + b, [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(16).cast("long"))
    return df.agg(F.sum(row)).first()[0] or 0


def _bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in a row."""
    if isinstance(kind, StringType | BinaryType):
        found = F.octet_length(value).cast("long") + 16
    elif isinstance(kind, ArrayType):
        inner = kind.elementType
        plain = not isinstance(inner, StringType | BinaryType | ArrayType | StructType)
        found = F.size(value).cast("long") * 8 + 16 if plain else F.aggregate(value, F.lit(24).cast("long"), lambda n, x: n + _bytes(x, inner))
    elif isinstance(kind, StructType):
        found = reduce(lambda a, b: a + b, [_bytes(value[f.name], f.dataType) for f in kind.fields], F.lit(24).cast("long"))
    else:
        found = F.lit(8).cast("long")
    return F.coalesce(found, F.lit(8).cast("long"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder, not yet made, where driver and executors can both read and write."""
    return f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"


#: Bytes of texts that a Python worker gets at once.
BATCH_BYTES = 4 << 20


def mapped(df: DataFrame, f, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes (rows hold whole texts). The session's setting is lowered for that,
    never raised."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"(\d+)b?$", conf.get(key))
    if now is None or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def run(batches):
        yield from f(batches)
        tidy()

    return df.mapInArrow(run, schema)


def tidy() -> None:
    """Give memory that a worker process no longer uses back to its machine: processes stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have this call
        ctypes.CDLL(None).malloc_trim(0)


_KEPT: dict = {}


def kept(key: tuple, make):
    """One object for a worker process, so that tasks after the first find it made. An object under another key takes
    its place, so a process that serves several operators holds one cache at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; rows without an id count as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def py_fold(doc_id, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def packed(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on, compressed: what small numbers share stands together."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 3)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def steps(x: np.ndarray) -> bytes:
    """Sorted numbers as packed differences."""
    return packed(np.diff(x, prepend=x.dtype.type(0)))


def summed(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpacked(data, kind), dtype=kind)
