"""Document fingerprints: order MinHash, sensitive to edit distance.

For each of ``SIGNATURES`` hash functions the ``TUPLE`` least k-mers of a text are selected; k-mers are numbered by
occurrence, so repeats count. The selected k-mers are put back into text order and the ordered tuple is hashed. Two
texts agree in a component if they share the selected k-mers *and* their order, which an edit, unlike a set
similarity, feels twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Code points in a k-mer, k-mers in a tuple, components of a fingerprint.
K, TUPLE, SIGNATURES = 8, 2, 32
_ODD = C.mix(np.arange(1, SIGNATURES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = C.mix(np.arange(101, SIGNATURES + 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def kmer_hashes(text: str) -> np.ndarray:
    """Hashes of the text's k-mers, numbered by occurrence. A text shorter than k is its own only k-mer."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < K:
        return C.mix(np.array([C.tuple_hash(np.r_[points, len(points)].astype(np.uint64), len(points) + 1)[0]], np.uint64))
    h = np.zeros(len(points) - K + 1, np.uint64)
    wide = points.astype(np.uint64) + np.uint64(1)
    for i in range(K):
        h *= np.uint64(0xD1342543DE82EF95)
        h += wide[i : i + len(h)]
    h = C.mix(h)
    ranked = np.sort(h)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if len(twice):
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h)
        order = at[np.argsort(h[at], kind="stable")]
        same = h[order]
        first = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
        number = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        h[order] = C.mix(same + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h


def signature(text: str, part: int = 4096) -> np.ndarray:
    """The fingerprint's 32-bit components. Long texts go part by part in bounded memory; the result is the same."""
    h = kmer_hashes(text)
    rows = np.arange(SIGNATURES)
    best, where = np.full((SIGNATURES, 0), 0, np.uint64), np.full((SIGNATURES, 0), 0, np.int64)
    for s in range(0, len(h), part):
        x = h[s : s + part] * _ODD[:, None]
        x += _ADD[:, None]
        x ^= x >> np.uint64(32)
        found, at = [], []
        for _ in range(min(TUPLE, x.shape[1])):
            j = x.argmin(1)
            found.append(x[rows, j])
            at.append(j + s)
            x[rows, j] = np.uint64(0xFFFFFFFFFFFFFFFF)
        best, where = np.column_stack([best, *found]), np.column_stack([where, *at])
        order = np.lexsort((where, best), axis=1)[:, :TUPLE]
        best, where = np.take_along_axis(best, order, 1), np.take_along_axis(where, order, 1)
    in_order = np.take_along_axis(where, np.argsort(where, axis=1), 1)
    out = _ADD.copy()
    for c in range(in_order.shape[1]):
        out = C.mix(out * np.uint64(3) + h[in_order[:, c]])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _shown(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def _row(doc, none: bool, text: str, sig: np.ndarray, next_text: str, next_sig: np.ndarray):
    n = len(text)
    edited = text[: n - n // 4] + next_text[: n // 4]
    edited_sig = sig if edited == text else signature(edited)
    return (doc, none, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), _shown(sig), _shown(edited_sig), likeness(sig, edited_sig), likeness(sig, next_sig))


COLUMNS = ["doc_id", "no_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, no_id boolean, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches):
    """Rows of one sorted range. Its first and last text wait for the neighbouring ranges as ``edge`` rows."""
    pid = TaskContext.get().partitionId()
    before = first = None
    for pdf in batches:
        rows = []
        for doc, none, text in zip(pdf["doc_id"], pdf["no_id"], pdf["text"]):
            text = text if isinstance(text, str) else ""
            sig = signature(text)
            if before is None:
                first = text
            else:
                rows.append((pid, None, None, *_row(*before, text, sig)))
            before = (doc, none, text, sig)
        yield pd.DataFrame(rows, columns=["pid", "first", "last", *COLUMNS])
    if before is not None:
        edge = pd.DataFrame([(pid, first, before[2], before[0], before[1], *[None] * 6)], columns=["pid", "first", "last", *COLUMNS])
        edge["n_chars"] = pd.array([len(before[2])], dtype="Int64")
        yield edge


def order_minhash(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text (see the columns of ``SCHEMA``).

    The edited text has its last n_chars // 4 code points replaced by the first as many (or all) of the next document
    in ascending doc_id, after the last the first. Null text is empty; an empty text's fingerprint is that of the
    empty sequence. Null doc_ids come last, rows that share a doc_id in order of a hash
    of their texts. A single document is
    its own next. An empty table gives an empty result.

    One range exchange brings neighbours together; each range then streams through, and only the texts at range
    ends (two a range) meet across ranges.
    """
    parts = max(2, 2 * C.block_count(docs))
    ordered = (
        C.keyed(docs, "text")
        .repartitionByRange(parts, "no_id", "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("no_id", "doc_id", F.xxhash64("text"), "text")
    )
    found = C.cut(ordered.mapInPandas(_walk, "pid int, first string, last string, " + SCHEMA), "order-minhash")
    # One row a range: the text after its last one is the first of the next range, in a ring.
    edges = found.where("first is not null")
    by = Window.orderBy("pid")  # one row a range, without its texts
    ranks = edges.select("pid").withColumn("rank", F.row_number().over(by)).withColumn("ranges", F.count("*").over(Window.partitionBy()))
    ring = edges.select("pid", "first", "last", "doc_id", "no_id").join(ranks, "pid")
    after = ring.select(F.when(F.col("rank") == 1, F.col("ranges")).otherwise(F.col("rank") - 1).alias("rank"), F.col("first").alias("next"))
    every = found.where("first is null").select(*COLUMNS).unionByName(ring.join(after, "rank").select("doc_id", "no_id", "last", "next").mapInPandas(_edge, SCHEMA))
    return every.select(C.doc_id(), *COLUMNS[2:])


def _edge(batches):
    for pdf in batches:
        rows = [_row(d, none, last, signature(last), nxt, signature(nxt)) for d, none, last, nxt in zip(pdf["doc_id"], pdf["no_id"], pdf["last"], pdf["next"])]
        yield pd.DataFrame(rows, columns=COLUMNS)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash over all of ``documents``."""
    return order_minhash(C.table(spark, sf_dir, "documents"))
