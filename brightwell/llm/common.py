"""What the training-data operators share: scratch tables, names and byte arithmetic."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
LAST_ID = 2**63 - 1
BATCH_ROWS, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: While a table is written: what is shuffled for it goes once it is there, and Python gets some bytes at once, as each batch is held by Spark, by Arrow and as Python's objects.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", BATCH_BYTES: "4194304"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only where none is set and driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="brightwell-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """While this lasts, these settings hold; for jobs that run within it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def batches_of(spark: SparkSession, rows: int) -> contextlib.AbstractContextManager:
    """While this lasts, Python gets at most so many rows at once."""
    return settings(spark, {BATCH_ROWS: str(rows)})


def trim() -> None:
    """Hands the memory that Python no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(f: Callable) -> Callable:
    """f, a function of batches; at its end the worker, which waits for other tasks, hands back what f took."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        trim()

    return run


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. The files of its shuffles are deleted as soon as it is written, so they add to those of no later step."""
    path = f"{shared_dir(df.sparkSession)}/brightwell/{label}-{uuid.uuid4().hex}"
    with settings(df.sparkSession, WRITING):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize wrote for these tables; no plan may read them after."""
    for t in tables:
        jvm = t.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(t._scratch)
        at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not use, whatever columns it brings."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text with null as empty; other columns are dropped unless named in more."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a whole text: two xxhash64 values of differently salted input."""
    return F.xxhash64(text), F.xxhash64(F.lit("brightwell"), text, F.length(text))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all 64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its inverse) modulo 2**64 for i < n."""
    key = "inverse" if inverse else "power"
    have = _powers.get(key)
    if have is None or len(have) < n:
        base = pow(BASE, -1, 2**64) if inverse else BASE
        have = np.ones(max(n, 1 << 16), U64)
        have[1:] = U64(base)
        have = np.multiply.accumulate(have)
        _powers[key] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (data[j]+1)*BASE**j over j < i; feeds span_hash."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes in [start, end) that depends on nothing outside them but their length."""
    inverse = powers(len(prefix), inverse=True)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))
