"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its byte n-grams (letters only, A-Z lower-cased, runs of other bytes
shown as one space), hashed into ``BUCKETS``; a linear layer and softmax give the languages' probabilities. Training
is stochastic gradient descent in numpy. A temperature fitted on a calibration split makes the probabilities honest,
and the same split sets the score below which a prediction counts as rejected.

Since everything before the softmax is linear, a trained model is one table of language scores for each bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Documented bound of the training sample: labelled documents, those with the smallest hashes of their ids.
SAMPLE = 3_000
#: Hash buckets, lengths of the n-grams in bytes, dimension of the embeddings, passes, documents a step, step size.
BUCKETS, GRAMS, DIM, PASSES, BATCH, RATE = 1 << 14, (2, 3, 4), 16, 8, 32, 0.05
#: Precision wanted of accepted predictions; n-grams whose table rows are held at a time.
PRECISION, GATHERED = 0.99, 1 << 17

_SHOWN = np.full(256, 32, np.uint8)
_SHOWN[97:123] = np.arange(97, 123)
_SHOWN[65:91] = np.arange(97, 123)
_SHOWN[128:] = np.arange(128, 256)


def buckets(buf: np.ndarray, bounds: np.ndarray):
    """Buckets of all n-grams of concatenated texts and the first n-gram of each text."""
    low = _SHOWN[buf]
    inner = np.ones(len(buf), bool)
    inner[1:] = (low[1:] != 32) | (low[:-1] != 32)
    inner[bounds[:-1][bounds[:-1] < len(buf)]] = True
    where = np.cumsum(inner)
    cuts = np.r_[0, where][bounds]
    low = low[inner].astype(np.uint32)
    out, owner = [], []
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    for n in GRAMS:
        size = len(low) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint32)
        for i in range(n):
            h = h * np.uint32(0x01000193) ^ low[i : i + size]
        h *= np.uint32(0x9E3779B1)
        stay = text[:size] == text[n - 1 :]
        out.append((h >> np.uint32(32 - BUCKETS.bit_length() + 1))[stay])
        owner.append(text[:size][stay])
    return out, owner


def features(texts: list[bytes]):
    """(distinct buckets, their shares) of each text."""
    for ids, buf, bounds in C.gather(texts):
        out, owner = buckets(buf, bounds)
        if not out:
            yield from ((np.zeros(0, np.int64), np.zeros(0, np.float32)) for _ in ids)
            continue
        code, count = np.unique(np.concatenate(owner) * BUCKETS + np.concatenate(out), return_counts=True)
        cuts = np.searchsorted(code, np.arange(len(ids) + 1) * BUCKETS)
        for i, j in zip(cuts[:-1], cuts[1:]):
            own = count[i:j].astype(np.float32)
            yield code[i:j] % BUCKETS, own / max(own.sum(), 1)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    table: np.ndarray  # bucket -> score of each language
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated probabilities, a row for each text. Sums table rows over the n-grams, ``GATHERED`` at a time."""
        table = self.table.astype(np.float64)
        out, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for ids, buf, bounds in C.gather(texts):
            for found, owner in zip(*buckets(buf, bounds)):
                for s in range(0, len(found), GATHERED):
                    own = owner[s : s + GATHERED]
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    at = ids[0] + own[first]
                    out[at] += np.add.reduceat(table[found[s : s + GATHERED]], first)
                    size[at] += np.diff(np.r_[first, len(own)])
        return _softmax((out / np.maximum(size, 1)[:, None] + self.bias) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    """Fit to labelled texts; None if there are none."""
    return train_features(list(features([C.as_bytes(t) for t in texts])), langs, seed)


def train_features(found: list, langs: list[str], seed: int = 7) -> Model | None:
    """Fit to labelled features (distinct buckets and their shares, of each text)."""
    names = sorted(set(langs))
    if not names:
        return None
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[: len(y) // 5] if len(y) >= 20 else order
    own = order[len(y) // 5 :] if len(y) >= 20 else order
    E = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    W = (rng.standard_normal((DIM, len(names))) * 0.1).astype(np.float32)
    bias = np.zeros(len(names), np.float32)

    def dense(rows):
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, r in enumerate(rows):
            x[i, found[r][0]] = found[r][1]
        return x

    squares = [np.full_like(p, 1e-8) for p in (E, W, bias)]  # per-parameter step sizes
    for _ in range(PASSES):
        own = rng.permutation(own)
        for s in range(0, len(own), BATCH):
            rows = own[s : s + BATCH]
            x = dense(rows)
            h = x @ E
            g = _softmax(h @ W + bias).astype(np.float32)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            grads = (x.T @ (g @ W.T), h.T @ g, g.sum(0))
            for p, q, d in zip((E, W, bias), squares, grads):
                q += d * d
                p -= RATE * d / np.sqrt(q)
    raw = np.concatenate([dense(held[s : s + 256]) @ E @ W + bias for s in range(0, len(held), 256)]).astype(np.float64)
    grid = np.exp(np.linspace(-2, 2, 81))
    loss = [-np.log(_softmax(raw / t)[np.arange(len(held)), y[held]] + 1e-300).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(raw / temperature)
    best, right = p.max(1), p.argmax(1) == y[held]
    down = np.argsort(-best, kind="stable")
    precise = np.flatnonzero(np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= PRECISION)
    threshold = float(best[down][precise[-1]]) if len(precise) else 1.0
    return Model(names, (E @ W).astype(np.float32), bias.astype(np.float64), temperature, threshold)


def _described(batches):
    """Features of labelled texts: at most ``BUCKETS`` pairs a text, however long it is."""
    for pdf in batches:
        found = list(features([C.as_bytes(t) for t in pdf["text"]]))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "place": pdf["place"], "lang": pdf["lang"], "buckets": [f[0].astype(np.uint16).tobytes() for f in found], "shares": [f[1].tobytes() for f in found]})


def _fitted(pdf: pd.DataFrame) -> Model | None:
    pdf = pdf.sort_values("doc_id", kind="stable")
    found = [(np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(s, np.float32)) for b, s in zip(pdf["buckets"], pdf["shares"])]
    return train_features(found, pdf["lang"].tolist())


def fit(docs: DataFrame) -> Model | None:
    """Train on documents with a language whose crc32(doc_id as text) mod 4 is not 2; a bounded sample of ``SAMPLE``.

    Of rows that share a doc_id one is learned from, that with the least hash of text and language. Executors make
    the features and fit; only the model reaches the driver.
    """
    doc = F.col("doc_id").cast("long")
    own = docs.select(doc.alias("doc_id"), "text", "lang").where("lang is not null and doc_id is not null and text is not null").where(C.crc_mod("doc_id", 4) != 2)
    picked = own.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = own.join(F.broadcast(picked), "doc_id").withColumn("place", F.xxhash64("text", "lang"))
    described = rows.mapInPandas(_described, "doc_id long, place long, lang string, buckets binary, shares binary")
    once = described.groupBy("doc_id").agg(F.min_by(F.struct("lang", "buckets", "shares"), "place").alias("own")).select("doc_id", "own.*")
    return C.fit_in_task(once, _fitted)


def has_letter(text) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (calibrated probability), rejected (score below the fitted threshold).

    Null texts and texts without a letter are ``und`` with score 0, as is everything without a trained language.
    Repeated rows are predicted each; a null doc_id is never held out. One pass over the scan; the model (a table of
    ``BUCKETS`` rows) is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        for pdf in batches:
            rows = []
            p = own.predict([C.as_bytes(t) for t in pdf["text"]]) if own is not None else None
            for i, (doc, none, text) in enumerate(zip(pdf["doc_id"], pdf["no_id"], pdf["text"])):
                if own is None or not has_letter(text):
                    rows.append((doc, none, "und", 0.0, True))
                else:
                    k = int(p[i].argmax())
                    rows.append((doc, none, own.langs[k], float(p[i, k]), bool(p[i, k] < own.threshold)))
            yield pd.DataFrame(rows, columns=["doc_id", "no_id", "lang_pred", "score", "rejected"])

    out = C.keyed(docs, "text").mapInPandas(run, "doc_id long, no_id boolean, lang_pred string, score double, rejected boolean")
    out = out.withColumn("doc_id", C.doc_id())
    held_out = F.coalesce(C.crc_mod("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the training folds and predict all of ``documents``."""
    docs = C.table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
