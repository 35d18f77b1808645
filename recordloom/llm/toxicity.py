"""Toxicity: maximum-scoring segments over token log-odds, with extreme-value calibration.

Training counts tokens of toxic and clean labelled documents, each once for every pair of neighbours it has there:
copies of one passage prove no more than the passage. Their log-odds under an informative Dirichlet prior (a token's
prior is its share of all tokens), less ``CAUTION`` standard errors, are the tokens' scores: every token has its own,
and what is rare or as common in clean text comes out below zero. A token that repeats the one before it says nothing
new and scores 0; an unseen one scores like one that clean text has once. A linear scan then finds every maximal
segment of positive score (all significant passages, not only the best). The best segment of clean text grows with
the logarithm of the length like an extreme value; a Gumbel law fitted to clean training documents turns a segment's
score and the text's length into a tail probability. What the segments have beyond ``SIGNIFICANT`` adds up, and a
logistic curve over it gives the probability of label 1.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Documented bound of the training sample: labelled documents, those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Prior weight as a share of the sample's counts; standard errors that a score stays below its log-odds.
PRIOR, CAUTION = 0.2, 2.0
#: -log of the chance in clean text from which a segment is evidence (5 %); least scale of the Gumbel law.
SIGNIFICANT, LEAST_SCALE = 3.0, 0.25
#: Ranges in which training tells contexts apart, one after the other: a power of two; those that are held at once.
SLICES, HELD = 16, 4

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens_of(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter runs, A-Z lower-cased: (hashes, first token of each text, byte starts, byte ends)."""
    letter = _LETTER[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[bounds] = True
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:-1]
    last[:-1] &= ~letter[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = C.span_hash(C.prefix_hash(_LOWER[buf]), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return h, np.searchsorted(starts, bounds), starts, ends


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [i, j) of a sequence, left to right, in linear time.

    Keeps candidate segments with the cumulative scores at their left and right ends. A new positive score is
    joined to the nearest candidate with a smaller left value unless that one's right value is no smaller.
    """
    found: list[list] = []  # left value, right value, start, end, link to the nearest candidate of smaller left value
    total = 0.0
    for i, s in enumerate(scores):
        if s > 0:
            new = [total, total + s, i, i + 1]
            j = len(found) - 1
            while True:
                while j >= 0 and found[j][0] >= new[0]:
                    j = found[j][4]
                if j < 0 or found[j][1] >= new[1]:
                    found.append([*new, j])
                    break
                new[0], new[2] = found[j][0], found[j][2]
                nxt = found[j][4]
                del found[j:]
                j = nxt
        total += s
    return [(a, b, r - lft) for lft, r, a, b, _ in found]


def _contexts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each token with its two neighbours in its text."""
    before, after = np.r_[np.uint64(0), h[:-1]], np.r_[h[1:], np.uint64(0)]
    inner = first[:-1][first[:-1] < len(h)]
    before[inner] = 0
    after[inner[inner > 0] - 1] = 0
    return C.mix(C.mix(before * np.uint64(3) + after) + h * np.uint64(0x9E3779B97F4A7C15))


def token_scores(bad: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, float]:
    """Scores of tokens from their counts in toxic and in clean contexts, and that of an unseen token."""
    bad, good = np.r_[bad, 0.0], np.r_[good, 1.0]  # the last is the unseen token
    own = PRIOR * (bad + good)
    weight = own[:-1].sum()
    a, b = bad + own, good + own
    odds = np.log(a / (bad.sum() + weight - a)) - np.log(b / (good.sum() + weight - b))
    score = odds - CAUTION * np.sqrt(1 / a + 1 / b)
    return score[:-1], float(score[-1])


@dataclass(frozen=True)
class Model:
    """Sorted token hashes and scores, the unseen token's, the Gumbel law (location, slope by log length, scale), the
    logistic curve."""

    hashes: np.ndarray
    scores: np.ndarray
    unseen: float
    location: float
    slope: float
    scale: float
    bias: float
    weight: float

    def passages(self, texts: list[bytes]):
        """Per text: (number of tokens, [(first byte, end byte, score)] of all its maximal segments)."""
        for ids, buf, bounds in C.gather(texts):
            h, first, starts, ends = tokens_of(buf, bounds)
            value = np.full(len(h), self.unseen)
            if len(self.hashes):
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                value = np.where(self.hashes[at] == h, self.scores[at], self.unseen)
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            same[first[:-1][first[:-1] < len(h)]] = False
            value[same] = 0
            upto = np.r_[0.0, np.cumsum(value)]
            hits = np.flatnonzero(value > 0)
            cuts = np.searchsorted(hits, first)
            for k in range(len(ids)):
                n, own = int(first[k + 1] - first[k]), hits[cuts[k] : cuts[k + 1]]
                # what lies between two tokens of positive score is one entry: no maximal segment begins or ends there
                gaps = upto[own[1:]] - upto[own[:-1] + 1]
                line = np.zeros(max(2 * len(own) - 1, 0))
                line[::2], line[1::2] = value[own], gaps
                yield n, [(int(starts[own[a // 2]] - bounds[k]), int(ends[own[(b - 1) // 2]] - bounds[k]), s) for a, b, s in segments(line.tolist())]

    def calibrated(self, n: int, best: float) -> float:
        """-log of the chance that clean text of n tokens holds a segment as good."""
        if best <= 0:
            return 0.0
        x = (best - self.location - self.slope * np.log(n + 1.0)) / self.scale
        return float(-np.log(-np.expm1(-np.exp(-min(x, 700.0))))) if x > -3 else 0.0

    def evidence(self, n: int, scores) -> float:
        """What all significant segments have beyond significance."""
        return sum(max(0.0, self.calibrated(n, s) - SIGNIFICANT) for s in scores)

    def probability(self, n: int, found: list) -> tuple[float, float]:
        """(probability of label 1, evidence)."""
        evidence = self.evidence(n, [s for *_, s in found])
        return float(1 / (1 + np.exp(-(self.bias + self.weight * np.log1p(evidence))))), evidence


def gumbel(n: np.ndarray, best: np.ndarray) -> tuple[float, float, float]:
    """(location, slope by log length, scale) of the clean documents' best segments.

    Median and 95th percentile, not moments: clean documents may hold toxic words by mistake.
    """
    x = np.log(n + 1)
    slope = max(0.0, float(np.polyfit(x, best, 1)[0])) if len(x) > 2 and np.ptp(x) > 0 else 0.0
    middle, high = np.quantile(best - slope * x, [0.5, 0.95])
    of = lambda q: -np.log(-np.log(q))
    scale = max(float((high - middle) / (of(0.95) - of(0.5))), LEAST_SCALE)
    return float(middle - of(0.5) * scale), slope, scale


class _Texts:
    """Texts that are read several times: packed in blocks of about 1 MB, of which one is unpacked at a time."""

    def __init__(self):
        self.blocks: list[tuple[bytes, list[int]]] = []
        self.open: list[bytes] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        self.open.append(text)
        self.size += len(text)
        if self.size >= 1 << 20:
            self.blocks.append((C.pack(b"".join(self.open)), [len(t) for t in self.open]))
            self.open, self.size = [], 0

    def __iter__(self) -> Iterator[bytes]:
        for blob, lengths in self.blocks:
            block, at = C.unpack(blob), 0
            for n in lengths:
                yield block[at : at + n]
                at += n
        yield from self.open


def _vocabulary(texts: Iterable[bytes]) -> np.ndarray:
    """Sorted hashes of all tokens."""
    vocab, fresh = np.zeros(0, np.uint64), []
    for _, buf, bounds in C.gather(texts):
        fresh.append(np.unique(tokens_of(buf, bounds)[0]))
        if len(fresh) == 16:
            vocab, fresh = np.unique(np.concatenate([vocab, *fresh])), []
    return np.unique(np.concatenate([vocab, *fresh]))


def _counts(texts: _Texts, chosen: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """Distinct contexts of each token of the vocabulary in the chosen texts.

    They are told apart in ``SLICES`` ranges of their hashes, ``HELD`` of which are held in each reading of the texts.
    """
    bits = np.uint64(64 - SLICES.bit_length() + 1)
    out = np.zeros(len(vocab))
    for k in range(0, SLICES, HELD):
        slices: list[list] = [[] for _ in range(HELD)]
        edges = np.arange(k + 1, k + HELD, dtype=np.uint64) << bits
        for _, buf, bounds in C.gather(t for t, own in zip(texts, chosen) if own):
            h, first, _, _ = tokens_of(buf, bounds)
            met = _contexts(h, first)
            now = np.flatnonzero((met >> bits) // np.uint64(HELD) == k // HELD)
            met, at = np.unique(met[now], return_index=True)
            code = np.searchsorted(vocab, h[now[at]]).astype(np.int32)
            cuts = [0, *np.searchsorted(met, edges).tolist(), len(met)]
            for own, i, j in zip(slices, cuts[:-1], cuts[1:]):
                own.append((met[i:j].copy(), code[i:j].copy()))
        while slices:
            met, code = (np.concatenate(x) for x in zip(*own)) if (own := slices.pop()) else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
            del own
            out += np.bincount(code[np.unique(met, return_index=True)[1]], minlength=len(vocab))
    return out


def train(texts: Iterable[str | bytes | None], labels: Iterable[int]) -> Model:
    """Fit a model to labelled texts. Without both labels nothing scores and the label's share is the answer.

    The texts are taken one by one and held packed; neither they nor their contexts are ever there as a whole.
    """
    raw, own, place = _Texts(), [], {}
    for t, label in zip(texts, labels):
        t = t if isinstance(t, bytes) else C.as_bytes(t)
        at = place.setdefault(hashlib.blake2b(t, digest_size=16).digest(), len(own))
        if at == len(own):
            raw.add(t)
            own.append(label)
        else:  # copies count once
            own[at] = label
    del place
    y = np.array(own, bool)
    share = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
    flat = float(np.log(share / (1 - share))) if 0 < share < 1 else -10.0
    vocab = _vocabulary(raw)
    if not len(vocab) or y.all() or not y.any():
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.0, 0.0, 1.0, flat, 0.0)
    scores, unseen = token_scores(*(_counts(raw, y == label, vocab) for label in (True, False)))
    model = Model(vocab, scores.astype(np.float32), unseen, 0.0, 0.0, 1.0, 0.0, 0.0)
    found = [(k, np.array([s for *_, s in f])) for k, f in model.passages(raw)]  # of a long text thousands
    n, best = np.array([k for k, _ in found], float), np.array([f.max() if len(f) else 0.0 for _, f in found])
    model = replace(model, **dict(zip(("location", "slope", "scale"), gumbel(n[~y], best[~y]))))
    evidence = np.log1p([model.evidence(k, f) for k, f in found])
    bias, weight = _logistic(evidence, y.astype(float))
    return replace(model, bias=bias, weight=weight)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-parameter logistic regression by Newton steps with a light ridge."""
    X, w = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-X @ w))
        step = np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]) + np.eye(2) * 0.1, X.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on labelled documents whose crc32(doc_id as text) mod 5 is not 0; a bounded sample of ``SAMPLE``.

    Of labels that share a doc_id the larger holds; of documents that share one, that with the least hash of its text
    is learned from. The sample is fitted in a task of its own; the driver gets the model.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (C.crc_mod("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    once = rows.groupBy("doc_id").agg(F.min_by(F.col("text").cast("binary"), F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"))

    def fitted(batches):
        parts = (part for batch in batches for part in C.text_slices(batch))
        rows, same = itertools.tee((t, label) for part, texts in parts for t, label in zip(texts, part.column("toxic").to_pylist()))
        model = train((t for t, _ in rows), (label for _, label in same))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # rows come in the order of their ids, a batch at a time: no copy of the sample is made in the task
    found = once.repartition(1).sortWithinPartitions("doc_id").mapInArrow(fitted, "model binary").first()
    return pickle.loads(found["model"]) if found else train([], [])


PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
SCORED = "doc_id long, no_id boolean, score double, predicted int, evidence double, passages array<struct<start:int,end:int,score:double>>"


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted, evidence and all significant passages (byte spans).

    Null and empty texts have no passage and get the base score. Repeated rows are scored each; a null doc_id is
    never held out. One pass over the scan; the model (12 bytes a token of the bounded sample) is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        for batch in batches:
            for part, texts in C.text_slices(batch):
                rows = []
                for n, found in own.passages(texts):
                    p, evidence = own.probability(n, found)
                    rows.append((p, int(p >= 0.5), evidence, [{"start": a, "end": b, "score": s} for a, b, s in found if own.calibrated(n, s) > SIGNIFICANT]))
                own_columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.float64(), pa.int32(), pa.float64(), PASSAGES))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("no_id"), *own_columns], names=["doc_id", "no_id", "score", "predicted", "evidence", "passages"])

    out = C.keyed(docs, "text").mapInArrow(run, SCORED).withColumn("doc_id", C.doc_id())
    held_out = F.coalesce(C.crc_mod("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence", "passages")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not predict toxic; one pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        for batch in batches:
            for part, texts in C.text_slices(batch):
                yield part.filter(pa.array([own.probability(n, found)[0] < 0.5 for n, found in own.passages(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the labelled folds and score all of ``documents``."""
    docs = C.table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, C.table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted", "evidence")
