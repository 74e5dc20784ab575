"""What the operators of this subpackage share: reading, scratch tables, packed exchange, hashing."""

from __future__ import annotations

import atexit
import contextlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python: texts are long, so batches stay short.
ARROW_ROWS = 256
#: Bytes of rows below which a side may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the memory of a Python worker by the length of Arrow batches; a session that has shorter ones keeps them.

    The setting is read when a plan runs, after the operator has returned, so it stays for the session. It changes
    how many rows a worker gets at once, never a result.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``, removed when the process ends.

    Only a local session may do without that setting and then has a folder in /tmp; on a cluster executors would
    not see each other's files there.
    """
    root = spark.conf.get("spark.symloom.corpus", None)
    if root:
        return root
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    root = f"{shared or 'file:///tmp'}/symloom-corpus-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
    spark.conf.set("spark.symloom.corpus", root)
    atexit.register(discard, spark, root)
    return root


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder by the file system that Spark uses for it."""
    with contextlib.suppress(Exception):  # the session may be gone; what is left is a temporary folder
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stash(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (cheap to count, such as a stash) hinted for broadcast if its checked size allows it."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def n_buckets(df: DataFrame, text: str, bytes_per_bucket: int) -> int:
    """How many buckets keep each at about ``bytes_per_bucket`` of text; follows the input without a cap."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-int(total) // bytes_per_bucket))


# ---- hashing: 64-bit, vectorised, the same in every process

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_WEIGHT = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (public 64-bit mixing constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``window_hash`` gives the hash of any substring of the bytes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_WEIGHT[data] * _power_table(BASE, len(data))[: len(data)], out=out[1:])
    return out


def window_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end): equal bytes, equal values, wherever they stand."""
    raw = (prefix[end] - prefix[start]) * _power_table(_INVERSE, len(prefix))[start]
    return mix(raw + (end - start).astype(np.uint64))


# ---- packed exchange: many small fixed-width records as one binary row for each task and bucket


def packed_rows(buckets: np.ndarray, records: np.ndarray):
    """(bucket, records of that bucket) pairs."""
    order = np.argsort(buckets, kind="stable")
    buckets, records = buckets[order], records[order]
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(buckets)], strict=True):
        if hi > lo:
            yield int(buckets[lo]), records[lo:hi]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts; null counts as empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    """Ids that are not null, as 64-bit integers; operators that keep null ids pass the column itself on."""
    return batch.column(name).cast(pa.int64()).to_numpy(zero_copy_only=True)
