"""Approximate nearest neighbours by collision counting over query-centred windows.

Unit vectors are projected on random lines, which are orthogonal in groups as large as the dimension: that evens out
how many windows a vector of a given distance falls into. Each block of the index keeps, for each line, its
projections in a sorted array. A query opens on every line a window around its own projection; a vector inside a
window has collided once. Virtual rehashing widens the windows round by round (radius times ``STEP``), and only the
newly covered ends of the sorted arrays are counted; windows of the first round that cover most of an array are
counted by what they leave out. The first radius is a little below that at which a few probes of the block find their
neighbours. A vector with collisions on a share of ``THRESHOLD`` of the lines
is verified with its exact cosine. A query stops once its k-th best verified vector is within the radius; the last
round covers everything, so no query ends with too few.

Every vector is indexed, once: the blocks of vectors are dealt out, each sorts its arrays, and the queries stream past
it in slices, so a task holds one block and one slice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Lines, window width in radii, share of lines on which a vector must collide, growth of the radius.
LINES, WIDTH, THRESHOLD, STEP = 192, 3.0, 0.845, 1.04
#: First radius as a share of the probes' median distance to their neighbours, and at least; probes of a block.
FIRST, LEAST, PROBES = 0.95, 0.2, 64
#: Vectors in a block, queries in a slice.
VECTORS, QUERIES = 8_192, 128


def lines(dim: int) -> np.ndarray:
    """Directions in orthogonal groups, scaled so that a projection of a vector has its length as standard deviation."""
    random = np.random.default_rng(20_240 + dim)
    turns = [np.linalg.qr(random.standard_normal((dim, min(dim, LINES))))[0] for _ in range(-(-LINES // dim))]
    return np.concatenate(turns, 1)[:, :LINES] * np.sqrt(dim)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors divided by the power of two next to their largest component: exact, and no square leaves the range."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


class Block:
    """Sorted arrays of one block of vectors of one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], scaled(vectors[order].astype(np.float64))
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.lines = lines(vectors.shape[1])
        projected = ((self.vectors / self.norms[:, None]) @ self.lines).astype(np.float32)
        self.order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(projected.T, self.order, 1)
        self.first = self._first_radius()
        #: vectors verified, over all queries
        self.verified = 0

    def _first_radius(self, k: int = 5) -> float:
        n = len(self.ids)
        own = np.unique(np.linspace(0, n - 1, min(n, PROBES)).astype(int))
        near = (self.vectors[own] / self.norms[own, None]) @ (self.vectors / self.norms[:, None]).T
        kth = np.sort(near, 1)[:, -min(k + 1, n)]  # the probe itself is the nearest
        return max(LEAST, FIRST * float(np.median(np.sqrt(np.maximum(2 - 2 * kth, 0)))))

    def windows(self, projected: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        half = np.float32(WIDTH * radius / 2)
        lo = np.stack([np.searchsorted(s, p - half, "left") for s, p in zip(self.sorted, projected.T)], 1)
        return lo, np.stack([np.searchsorted(s, p + half, "right") for s, p in zip(self.sorted, projected.T)], 1)

    def _collisions(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors in the parts, and how often; few are told by sorting them, many by counting over the block."""
        met = np.concatenate(parts)
        if len(met) * 8 < len(self.ids):
            return np.unique(met, return_counts=True)
        times = np.bincount(met, minlength=len(self.ids))
        at = np.flatnonzero(times)
        return at, times[at]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int):
        """(query, vec, score) of the k best verified vectors of each query."""
        queries = scaled(queries.astype(np.float64))
        norms = np.sqrt((queries * queries).sum(1))
        projected = ((queries / norms[:, None]) @ self.lines).astype(np.float32)
        radii = [self.first * STEP**i for i in range(256) if self.first * STEP**i < 2.6]
        need = int(np.ceil(THRESHOLD * LINES))
        n, arrays = len(self.ids), self.order
        state = [(None, np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
        live, a, b = list(range(len(ids))), None, None
        for radius in [*radii, np.inf]:
            lo, hi = (np.zeros((len(ids), LINES), np.int64), np.full((len(ids), LINES), n)) if radius == np.inf else self.windows(projected, radius)
            going = []
            for i in live:
                count, found, scores = state[i]
                if count is None:
                    if (hi[i] - lo[i]).sum() * 2 > n * LINES:
                        parts = [o[:x] for o, x in zip(arrays, lo[i])] + [o[y:] for o, y in zip(arrays, hi[i])]
                        count = LINES - np.bincount(np.concatenate(parts), minlength=n)
                    else:
                        count = np.bincount(np.concatenate([o[x:y] for o, x, y in zip(arrays, lo[i], hi[i])]), minlength=n)
                    count = count.astype(np.int16)
                    new = np.flatnonzero(count >= need)
                else:
                    parts = [o[x:y] for o, x, y in zip(arrays, lo[i], a[i])] + [o[x:y] for o, x, y in zip(arrays, b[i], hi[i])]
                    at, times = self._collisions(parts)
                    old = count[at]
                    count[at] = old + times
                    new = at[(old < need) & (old + times >= need)]
                if len(new):
                    new = new[self.ids[new] != ids[i]]
                    self.verified += len(new)
                    own = (self.vectors[new] * queries[i]).sum(1) / (self.norms[new] * norms[i])
                    found, scores = np.concatenate([found, new]), np.concatenate([scores, own])
                    best = np.lexsort((self.ids[found], -scores))[:k]
                    found, scores = found[best], scores[best]
                state[i] = count, found, scores
                if len(found) < k or scores[-1] < 1 - radius * radius / 2:
                    going.append(i)
            live, a, b = going, lo, hi
            if not live:
                break
        for i, query in enumerate(ids):
            for v, s in zip(self.ids[state[i][1]].tolist(), state[i][2].tolist()):
                yield int(query), v, s


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["vector"].to_list())


def _stream(k: int):
    """Rows come sorted by block and dimension, the block's vectors before the queries."""

    def run(batches):
        at, own, block = None, [], None
        for pdf in batches:
            rows = []
            for (vb, dim, query), part in pdf.groupby(["vb", "dim", "query"], sort=True):
                if (vb, dim) != at:
                    at, own, block = (vb, dim), [], None
                if not query:
                    own.append(part)
                    continue
                if block is None and own:
                    block, own = Block(*_matrix(pd.concat(own))), []
                for s in range(0, len(part) if block else 0, QUERIES):
                    rows += block.search(*_matrix(part.iloc[s : s + QUERIES]), k)
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors of largest cosine for each query, itself excluded.

    Both tables have vec_id and embedding. Rows whose vec_id or embedding is null, empty, all zero, or holds a null
    or non-finite component take no part; vectors of different lengths never meet. Equal scores go to the smaller
    vec_id. Of rows that share a vec_id each is a candidate; queries that share one are answered together, with the k
    best of all that they find. Components may be as large or small as doubles can be. Empty tables give an empty result.
    """
    own, asked = _valid(vectors), _valid(queries)
    blocks = max(1, -(-own.count() // VECTORS))
    left = own.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("vb"), "dim", F.lit(False).alias("query"), "vec_id", "vector")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("vb"), "dim", F.lit(True).alias("query"), "vec_id", "vector")
    dealt = left.unionByName(right).repartitionByRange(blocks, "vb").sortWithinPartitions("vb", "dim", "query", "vec_id")
    met = dealt.mapInPandas(_stream(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _valid(df: DataFrame) -> DataFrame:
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = F.exists(vector, lambda x: x != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.size("embedding").alias("dim")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & some)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all ``embeddings`` for every row whose vec_id is divisible by 50."""
    vectors = C.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
