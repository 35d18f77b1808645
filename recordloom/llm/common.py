"""Shared pieces of the training-data operators: shared folder, block sizes, vectorised byte hashing."""

from __future__ import annotations

import gc
import pickle
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of bytes other than space and \t\n\v\f\r, which is what bytes.split() takes too.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Set here only where the session has none and driver and executors are one process; a cluster must name its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "/tmp/recordloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs a reread, never a recomputation. What only fed the written table
    (shuffle files, broadcasts) is released for cleaning.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(at)


def release(spark: SparkSession) -> None:
    """Let Spark clean shuffle files that nothing refers to any more, now rather than at the driver's next collection."""
    for _ in range(2):  # the first round lets go of what Python holds, the second of what that held in the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def settle(spark: SparkSession) -> None:
    """Let the driver and, by a task for each core, the executors collect their garbage: heaps shrink to what lives.

    Else a heap stays as large as the last step made it, beside what the Python workers of the next one take.
    """
    release(spark)
    cores = spark.sparkContext.defaultParallelism
    for _ in range(2):  # a heap shrinks by what the first round found free
        spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def keyed(docs: DataFrame, *columns) -> DataFrame:
    """doc_id as a number that is never null, no_id where it was, and ``columns``.

    pandas holds a nullable long as a double, which rounds ids above 2**53; so no nullable id passes through pandas.
    """
    doc = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc, F.lit(0).cast("long")).alias("doc_id"), doc.isNull().alias("no_id"), *columns)


def doc_id():
    """The id of rows that ``keyed`` made: null again where it was."""
    return F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id")


def block_count(docs: DataFrame, per_block: int = 8 << 20) -> int:
    """Number of text blocks of about ``per_block`` bytes of text; grows with the input, without a cap.

    Counts the texts' own bytes (one narrow pass): stored sizes say little of repetitive text.
    """
    return max(1, -(-(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // per_block))


def block_of(blocks: int):
    """The block of a document; rows without an id or with the same id spread by their texts."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("blk")


def fit_in_task(rows: DataFrame, train):
    """What ``train`` makes of a bounded sample, in one task: the driver gets the model, never the texts.

    ``rows`` has as many rows at most as the sample's documented bound; ``train`` takes them as a pandas frame.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [pickle.dumps(train(pdf))]})

    found = rows.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(run, "model binary").first()
    return pickle.loads(found["model"]) if found else None


def crc_mod(column: str, n: int):
    """crc32(column as text) mod n, the folds of the contracts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


# ---------------------------------------------------------------------------------------------------------------------
# Vectorised polynomial hashing modulo 2**64.

_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n; kept between calls and grown by doubling."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, b in enumerate((_BASE, _INVERSE)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = base**i * hash(buf[i:j])."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * up[: len(buf)], out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end): equal spans have equal hashes."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def tuple_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbours in h (order matters)."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * _BASE + h[i : len(h) - n + 1 + i] + np.uint64(i + 1))
    return out


def gather(texts: Iterable[bytes], limit: int = 1 << 17) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Concatenate neighbouring texts into buffers of about ``limit`` bytes: (indices, buffer, bounds).

    Whole texts only; a text above the limit has a buffer of its own. The limit keeps 64-bit arrays in the cache.
    """
    ids: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        if parts and size + len(t) > limit:
            yield _joined(ids, parts)
            ids, parts, size = [], [], 0
        ids.append(i)
        parts.append(t)
        size += len(t)
    if parts:
        yield _joined(ids, parts)


def _joined(ids, parts):
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    return ids, np.frombuffer(b"".join(parts), np.uint8), bounds


#: The space and \t\n\v\f\r of the contracts' word pattern.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words of concatenated texts: (word hashes, first word of each text, word starts).

    The second array has one entry more than there are texts. Words never cross texts.
    """
    low = _LOWER[buf]
    black = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[bounds] = True
    first = black.copy()
    first[1:] &= ~black[:-1] | edge[1:-1]
    last = black.copy()
    last[:-1] &= ~black[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = span_hash(prefix_hash(low), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return h, np.searchsorted(starts, bounds), starts


def ranges(b: np.ndarray):
    """(value, first, end) of each run of equal values in a sorted array: only buckets that hold something are named."""
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    return zip(b[first].tolist(), first.tolist(), [*first[1:].tolist(), len(b)])


def pack(data) -> bytes:
    """Compress what is exchanged: packed arrays and front-coded runs shrink far more than the shuffle's codec does."""
    return zstandard.ZstdCompressor(level=3).compress(bytes(data))


def unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def text_slices(batch: pa.RecordBatch, rows: int = 1_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with their texts as UTF-8 bytes (null: empty); only one part's texts are copied at a time."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def as_bytes(text) -> bytes:
    """UTF-8 bytes of a text; null is the empty text."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
