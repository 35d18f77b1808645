"""LM scoring: a Brown class-based bigram model.

log P(text) = sum over tokens of log P(class | class before) + log P(word | class). Words are put into classes by
exchange clustering: words move to the class where the training bigrams' likelihood is largest. Every word that occurs
``FLOOR`` times is exchanged, so their number grows with the corpus. The ``WORDS`` most frequent are first exchanged one
after the other, which gives the classes to start from; then all are exchanged in steps over the sparse bigram counts,
dealt by word. In a step a half of the words moves at once, each to its best class given the classes of all others; a
step that doesn't raise the likelihood is undone, and from then on a quarter as many move at once. After ``STEPS`` steps
it ends, whether or not a move is left. Words below the floor are put into the class that is likeliest from the classes
around their own occurrences. Unseen words are one class, and so is the end of a text.

All counts cover the whole training corpus. A word's count is needed where the word is, for vocabularies of any size:
blocks of documents send their distinct words as packed sorted hashes with counts to the words' owners, who add up
and answer each block with its words' totals. A block then reduces each document to a few sums and its class
transitions, from which the scores follow once the corpus-wide class counts are known.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Least count of an exchanged word; words that are exchanged one by one to start with, classes, sweeps over these at
#: most, steps of the exchange of all words at most.
FLOOR, WORDS, CLASSES, SWEEPS, STEPS = 10, 1_000, 60, 8, 10
#: Classes of unseen words and of the end. While words are exchanged, the first is that of all other words.
UNSEEN, END, TOTAL = CLASSES, CLASSES + 1, CLASSES + 2
#: Weight of the class unigram in smoothed transitions, added count.
BACKOFF, ADD = 2.0, 0.5


def _texts(pdf: pd.DataFrame):
    """Which documents train, and their texts as bytes."""
    return pdf["train"].to_numpy(bool), [C.as_bytes(t) for t in pdf["text"]]


def _tokens(texts: list[bytes]):
    """Word hashes of all texts and the first word of each."""
    parts, firsts, n = [], [], 0
    for _, buf, bounds in C.gather(texts):
        h, first, _ = C.words_of(buf, bounds)
        parts.append(h)
        firsts.append(first[:-1] + n)
        n += len(h)
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return h, np.concatenate([*firsts, [n]]).astype(np.int64)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the place of each among them; only what is distinct is sorted."""
    code, found = pd.factorize(h)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[code]


def _owned(train: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.repeat(train, np.diff(first))


def _count(buckets: int):
    shift = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        train, texts = _texts(pdf)
        h, first = _tokens(texts)
        words, _ = np.unique(h, return_counts=True)  # numpy sorts if it counts, and hashes, which takes longer, if not
        own, n = np.unique(h[_owned(train, first)], return_counts=True)
        counts = np.zeros(len(words), np.int32)
        counts[np.searchsorted(words, own)] = n
        b = (words >> shift).astype(np.int64) if shift is not None else np.zeros(len(words), np.int64)
        rows = [(int(pdf["blk"].iloc[0]), k, words[i:j].tobytes(), C.pack(counts[i:j].tobytes())) for k, i, j in C.ranges(b)]
        return pd.DataFrame(rows, columns=["blk", "bucket", "words", "counts"])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Owners of one range of words: totals for every block that asked; the first asker also reports the words.

    An owner's totals are exact, and a word has one owner, so all words from ``FLOOR`` on are reported, once each.
    """
    order = np.argsort(pdf["blk"].to_numpy(), kind="stable")
    blks = pdf["blk"].to_numpy()[order]
    words = [np.frombuffer(pdf["words"].iloc[i], np.uint64) for i in order]
    counts = [np.frombuffer(C.unpack(pdf["counts"].iloc[i]), np.int32) for i in order]
    every, code = _distinct(np.concatenate(words))
    totals = np.bincount(code, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
    top = totals >= FLOOR
    new = np.ones(len(every), bool)
    rows, at = [], 0
    for i, (blk, w) in enumerate(zip(blks, words)):
        own = code[at : at + len(w)]
        at += len(w)
        rows.append((int(blk), C.pack(totals[own].tobytes()), C.pack(np.packbits(new[own]).tobytes()), int(pdf["bucket"].iloc[0]), *((None, None) if i else (every[top].tobytes(), totals[top].tobytes()))))
        new[own] = False
    return pd.DataFrame(rows, columns=["blk", "totals", "new", "bucket", "top", "top_n"])


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 on, packed in the fewest bytes a number that hold them all."""
    x = x.astype(np.min_scalar_type(x.max(initial=0)))
    return x.dtype.char.encode() + C.pack(x.tobytes())


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(C.unpack(blob[1:]), chr(blob[0]))


def _packed(code: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted codes as the first of them and differences, and their counts."""
    return code[:1].astype(np.int64).tobytes() + _narrow(np.diff(code)), _narrow(n)


def _unpacked(code: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = _wide(n).astype(np.int64)
    out = np.zeros(len(n), np.int64)
    if len(n):
        out[0] = np.frombuffer(code, np.int64, 1)[0]
        np.cumsum(_wide(code[8:]), dtype=np.int64, out=out[1:])
        out[1:] += out[0]
    return out, n


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) == 1:
        return codes[0], counts[0]
    code = np.concatenate(codes)
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    return code[first], np.add.reduceat(np.concatenate(counts)[order], first) if len(first) else np.zeros(0, np.int64)


PAIRS = "part long, side int, code binary, n binary"


def _neighbours(own: np.ndarray, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the pairs of symbols that stand together in the training texts."""
    _, texts = _texts(pdf[pdf["train"]])
    h, first = _tokens(texts)
    words, code = _distinct(h)
    seq = np.insert(_symbols(own, words)[code], first, len(own) + 1)  # an end before every text, and after the last
    del h, code
    return np.unique(seq[:-1].astype(np.int64) * (len(own) + 2) + seq[1:], return_counts=True)


def _bigrams(names, parts: int):
    """Counts of neighbouring pairs of exchanged words (others are one symbol, the end another), sparse.

    Side 0 has what stands after each word, side 1 what stands before it; both are dealt by ranges of words. Pairs of
    the two last symbols are on side 0. Side 2 has of side 1 what side 0 lacks: the two last symbols before words.
    """

    def run(batches):
        own = names.value
        size = len(own) + 2
        total = []
        for pdf in batches:
            total = [_summed(*zip(*total, _neighbours(own, pdf)))]
        edges = _edges(len(own), parts) * size
        edges[-1] = size * size
        code, n = total[0] if total else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        left = code // size
        right = code - left * size
        turned = right * size + left
        order = np.argsort(turned)
        order = order[: np.searchsorted(turned[order], len(own) * size)]
        fore = np.flatnonzero((left < len(own)) | (right >= len(own)))
        rest = order[left[order] >= len(own)]
        rows = []
        for side, (c, m) in enumerate(((code[fore], n[fore]), (turned[order], n[order]), (turned[rest], n[rest]))):
            cuts = np.searchsorted(c, edges)
            rows += [(k, side, *_packed(c[i:j], m[i:j])) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
        yield pd.DataFrame(rows, columns=["part", "side", "code", "n"])

    return run


def _edges(words: int, parts: int) -> np.ndarray:
    return np.arange(parts + 1, dtype=np.int64) * words // parts


SIDES = ["fore", "fore_n", "back", "back_n", "rest", "rest_n"]
MERGED = ", ".join(["part long", *(f"{c} binary" for c in SIDES)])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """All of one part as one row, so that every step of the exchange reads it without dealing it out again."""
    row = [int(pdf["part"].iloc[0])]
    for side in (0, 1, 2):
        own = [_unpacked(c, n) for c, n, s in zip(pdf["code"], pdf["n"], pdf["side"]) if s == side]
        row += _packed(*(_summed(*map(list, zip(*own))) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64))))
    return pd.DataFrame([row], columns=["part", *SIDES])


def _table(pairs: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """Bigram counts of symbols' classes: only cells of the table reach the driver."""
    sent = pairs.sparkSession.sparkContext.broadcast(of)

    def run(batches):
        of, full = sent.value.astype(np.int64), len(sent.value)
        found = np.zeros(size * size)
        for pdf in batches:
            for side in ("fore", "rest"):
                for code, n in map(_unpacked, pdf[side], pdf[side + "_n"]):
                    v = code // full
                    a, b = v, code - v * full
                    if side == "rest":
                        a, b = b, a
                    found += np.bincount(of[a] * size + of[b], weights=n, minlength=size * size)
        cell = np.flatnonzero(found)
        yield pd.DataFrame({"cell": cell, "n": found[cell].astype(np.int64)})

    out = np.zeros(size * size)
    cells = pairs.select("fore", "fore_n", "rest", "rest_n").mapInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy()
    sent.unpersist()
    return out.reshape(size, size)


def _xlogx(x):
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """The part of the training bigrams' likelihood that depends on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def _alike(counts: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The place of each (count, class) among the distinct ones, and these."""
    place, found = pd.factorize(counts.astype(np.int64) * TOTAL + k)
    return place, (found // TOTAL, found % TOTAL)


def best_classes(of: np.ndarray, table: np.ndarray, after: np.ndarray, before: np.ndarray, selves: np.ndarray) -> np.ndarray:
    """The class of each word with which the likelihood is largest if all others stay as they are.

    ``of`` has the words' present classes, ``after`` and ``before`` their counts by class after and before (pairs of a
    word with itself are in ``selves`` only).
    """
    rows_all, cols_all = table.sum(1), table.sum(0)
    d = np.arange(CLASSES)
    gain = np.zeros((len(of), CLASSES))
    for side, (x, y, t) in enumerate(((after, before, table), (before, after, table.T))):
        w, j = np.nonzero(x)
        columns = t[:CLASSES].T
        logs = _xlogx(columns)
        for at in np.array_split(np.arange(len(w)), -(-len(w) // 20_000) or 1):  # bounded memory
            if not len(at):
                continue
            v, k = w[at], j[at]
            add = x[v, k]
            # Words with the same count beside a class gain the same there: taken once for all of them.
            same, (adds, ks) = _alike(add, k)
            gains = (_xlogx(columns[ks] + adds[:, None]) - logs[ks])[same]
            # Only a word's own class, and all classes beside it, lack the word: elsewhere the logs are the table's.
            inside = np.flatnonzero(of[v] < CLASSES)
            c = of[v[inside]]
            old = columns[k[inside], c] - add[inside]
            gains[inside, c] = _xlogx(old + add[inside]) - _xlogx(old)
            beside = np.flatnonzero(k == of[v])
            old = columns[k[beside]] - y[v[beside]][:, :CLASSES]
            both = np.flatnonzero(of[v[beside]] < CLASSES)
            old[both, of[v[beside[both]]]] -= add[beside[both]] + selves[v[beside[both]]]
            gains[beside] = _xlogx(old + add[beside][:, None]) - _xlogx(old)
            starts = np.flatnonzero(np.diff(v, prepend=-1))  # rows of a word are neighbours
            gain[v[starts]] += np.add.reduceat(gains, starts)
    own = np.arange(len(of))
    stays = d == of[:, None]
    right, left = after[:, :CLASSES], before[:, :CLASSES]
    old = np.diag(table)[:CLASSES] - stays * (right + left + selves[:, None])
    gain -= _xlogx(old + right) + _xlogx(old + left) - _xlogx(old)
    gain += _xlogx(old + right + left + selves[:, None])
    for all_of, n in ((rows_all, after.sum(1) + selves), (cols_all, before.sum(1) + selves)):
        old = all_of[:CLASSES] - stays * n[:, None]
        gain -= _xlogx(old + n[:, None]) - _xlogx(old)
    best = gain.argmax(1)
    now = np.minimum(of, CLASSES - 1)
    return np.where((of < CLASSES) & (gain[own, best] <= gain[own, now] + 1e-9), of, best)


def _moves(pairs: DataFrame, of: np.ndarray, table: np.ndarray, parts: int, moving: np.ndarray) -> np.ndarray:
    """Where each word that is ``moving`` would move, the others' classes; one byte a word reaches the driver."""
    sent = pairs.sparkSession.sparkContext.broadcast((of, table, np.packbits(moving)))
    words = len(of) - 2
    edges = _edges(words, parts)

    def run(batches):
        of, table, moving = sent.value
        full = len(of)
        moving = np.unpackbits(moving)[:full].astype(bool)
        for pdf in batches:
            for part, row in zip(pdf["part"].tolist(), range(len(pdf))):
                a, b = int(edges[part]), int(edges[part + 1])
                best, own = of[a:b].copy(), moving[a:b]
                go = np.flatnonzero(own)
                found, selves = [], np.zeros(len(go))
                for side in ("fore", "back"):
                    code, n = _unpacked(pdf[side].iloc[row], pdf[side + "_n"].iloc[row])
                    each = np.diff(np.searchsorted(code, np.arange(a, b + 1) * full))  # pairs of each word
                    use = np.flatnonzero(np.repeat(own, each))
                    v = np.repeat(np.arange(len(go)), each[go])
                    x, n = code[use] - (go[v] + a) * full, n[use]
                    same = np.flatnonzero(x == go[v] + a)
                    selves[v[same]] = n[same]
                    n[same] = 0
                    found.append(np.bincount(v * TOTAL + of[x], weights=n, minlength=len(go) * TOTAL).reshape(-1, TOTAL))
                best[go] = best_classes(of[a:b][go].astype(np.int64), table, *found, selves).astype(np.uint8)
                yield pd.DataFrame({"part": [part], "best": [best.tobytes()]})

    out = of.copy()
    for r in pairs.select("part", "fore", "fore_n", "back", "back_n").mapInPandas(run, "part long, best binary").collect():
        out[edges[r["part"]] : edges[r["part"] + 1]] = np.frombuffer(r["best"], np.uint8)
    sent.unpersist()
    return out


def cluster(pairs: DataFrame, totals: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of every exchanged word (and the two last symbols), and the class bigrams that they give."""
    words = len(totals)
    top = np.lexsort((np.arange(words), -totals))[:WORDS]
    first = np.full(words + 2, len(top), np.int32)
    first[top] = np.arange(len(top))
    first[-1] = len(top) + 1
    of = np.full(words + 2, UNSEEN, np.uint8)
    of[-1] = END
    of[top] = exchange(_table(pairs, first, len(top) + 2))
    table = _table(pairs, of, TOTAL)
    if words > len(top):  # the others join them, all at once
        of = _moves(pairs, of, table, parts, np.append(of[:-2] == UNSEEN, [False, False]))
        table = _table(pairs, of, TOTAL)
        groups = turn = 2
        for _ in range(STEPS):
            moving = np.append(np.arange(words) % groups == turn % groups, [False, False])
            new = _moves(pairs, of, table, parts, moving)
            if (new == of).all():
                turn += 1
                continue
            changed = _table(pairs, new, TOTAL)
            if likelihood(changed) > likelihood(table):
                of, table, turn = new, changed, turn + 1
            else:
                groups *= 4
    return of, table


def _symbols(names: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Position of each word among the sorted names; len(names) for all others."""
    if not len(names):
        return np.zeros(len(h), np.int32)
    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
    return np.where(names[at] == h, at, len(names)).astype(np.int32)


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word by exchange clustering; ``pairs`` are bigram counts of words, the last two symbols fixed.

    Maximises sum n(c,d) log n(c,d) - sum n(c,.) log n(c,.) - sum n(.,d) log n(.,d) over class bigrams, the part of
    the likelihood that depends on the classes. The two last symbols (all other words, end) keep classes of their own.
    """
    size = len(pairs)
    words = size - 2
    k = min(classes, max(words, 1))
    volume = pairs.sum(0) + pairs.sum(1)
    of = np.empty(size, np.int64)
    of[np.argsort(-volume[:words], kind="stable")] = np.arange(words) % k
    of[words], of[words + 1] = k, k + 1
    n = k + 2
    member = np.zeros((size, n))
    member[np.arange(size), of] = 1
    table = member.T @ pairs @ member
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for _ in range(sweeps):
        moved = 0
        out_of, into = pairs @ member, pairs.T @ member  # word -> class after it; class before it
        for w in np.argsort(-volume[:words], kind="stable"):
            c, self_pair = of[w], pairs[w, w]
            right, left = out_of[w].copy(), into[w].copy()
            right[c] -= self_pair
            left[c] -= self_pair
            # take the word out
            table[c, :] -= right
            table[:, c] -= left
            table[c, c] -= self_pair
            rows, cols = table.sum(1) + left, table.sum(0) + right  # what stands before w, after w, is there in any class
            # gain of putting it into each class d: changes of row d, column d and their crossing
            gain = (xlogx(table + right[None, :]) - xlogx(table)).sum(1) + (xlogx(table + left[:, None]) - xlogx(table)).sum(0)
            diagonal = np.diag(table)
            gain -= (xlogx(diagonal + right) - xlogx(diagonal)) + (xlogx(diagonal + left) - xlogx(diagonal))
            gain += xlogx(diagonal + right + left + self_pair) - xlogx(diagonal)
            r, m = right.sum() + self_pair, left.sum() + self_pair
            gain -= xlogx(rows + r) - xlogx(rows) + xlogx(cols + m) - xlogx(cols)
            d = int(gain[:k].argmax())
            if gain[d] <= gain[c] + 1e-9:
                d = c
            table[d, :] += right
            table[:, d] += left
            table[d, d] += self_pair
            if d != c:
                moved += 1
                of[w] = d
                member[w, c], member[w, d] = 0, 1
                out_of[:, c] -= pairs[:, w]
                out_of[:, d] += pairs[:, w]
                into[:, c] -= pairs[w, :]
                into[:, d] += pairs[w, :]
        if not moved:
            break
    return of[:words]


TOLD = "blk long, totals binary, new binary, bucket long, top binary, top_n binary"
REDUCED = "doc_id long, no_id boolean, train boolean, n_tokens long, n_known long, log_counts double, codes array<int>, times array<int>, kinds array<long>, masses array<long>, moves array<long>"


def _answers(answers: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """What owners told a block: rows in order of its words, their totals, and how many words each row has."""
    parts = answers.sort_values("bucket", kind="stable")
    raw = list(map(C.unpack, parts["totals"]))
    return parts, np.frombuffer(b"".join(raw), np.int64), np.array([len(x) // 8 for x in raw], np.int64)


def _rare(totals: np.ndarray) -> np.ndarray:
    return (totals > 0) & (totals < FLOOR)


def _contexts(names, classes):
    """Blocks send the words below the floor with the classes before and after each training occurrence."""

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["blk", "bucket", "words", "times", "around"]
        if not len(docs):
            return pd.DataFrame(columns=columns)
        train, texts = _texts(docs)
        h, first = _tokens(texts)
        words, code = _distinct(h)
        parts, totals, sizes = _answers(answers)
        kind = np.append(classes.value[:-2], UNSEEN)[_symbols(names.value, words)].astype(np.uint8)
        rare = _rare(totals)
        line = np.insert(kind[code], first, END)
        at = np.arange(len(h)) + np.repeat(np.arange(1, len(first)), np.diff(first))  # of each word in the line
        use = np.flatnonzero(_owned(train, first) & rare[code])
        use = use[np.argsort(code[use], kind="stable")]
        around = np.stack([line[at[use] - 1], line[at[use] + 1]], 1).astype(np.uint8)
        times = np.bincount(code[use], minlength=len(words))
        ends = np.append(0, np.cumsum(times))
        rows, a = [], 0
        for bucket, n in zip(parts["bucket"], sizes):
            own = np.flatnonzero(rare[a : a + n]) + a
            if len(own):
                rows.append((int(docs["blk"].iloc[0]), int(bucket), words[own].tobytes(), C.pack(times[own].astype(np.uint8).tobytes()), C.pack(around[ends[a] : ends[a + n]].tobytes())))
            a += n
        return pd.DataFrame(rows, columns=columns)

    return run


def _place(table):
    """Owners put each word below the floor into the class likeliest from all its contexts, and tell every block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk", kind="stable")
        words = [np.frombuffer(x, np.uint64) for x in pdf["words"]]
        times = np.concatenate([np.frombuffer(C.unpack(x), np.uint8) for x in pdf["times"]])
        around = np.concatenate([np.frombuffer(C.unpack(x), np.uint8).reshape(-1, 2) for x in pdf["around"]])
        every, code = _distinct(np.concatenate(words))
        t = table.value + ADD
        logs = np.log(t)
        rows, cols = np.log(t.sum(1)), np.log(t.sum(0))
        found = np.repeat(code, times)
        left = np.bincount(found * TOTAL + around[:, 0], minlength=len(every) * TOTAL).reshape(-1, TOTAL)
        right = np.bincount(found * TOTAL + around[:, 1], minlength=len(every) * TOTAL).reshape(-1, TOTAL)
        score = left @ logs[:, :CLASSES] + right @ logs[:CLASSES].T - np.bincount(found, minlength=len(every))[:, None] * (rows + cols)[:CLASSES]
        best = score.argmax(1).astype(np.uint8)[code]
        ends = np.cumsum([0, *map(len, words)])
        return pd.DataFrame([(int(b), int(k), C.pack(best[i:j].tobytes())) for b, k, i, j in zip(pdf["blk"], pdf["bucket"], ends[:-1], ends[1:])], columns=["blk", "bucket", "placed"])

    return run


def _classes(symbols: np.ndarray, counts: np.ndarray, exchanged: np.ndarray, placed: np.ndarray) -> np.ndarray:
    """Class of each word: the exchanged words' own, for others where they were placed, and one of the unseen."""
    known = np.where(symbols < len(exchanged), np.append(exchanged, 0)[symbols], placed)
    return np.where(counts > 0, known, UNSEEN).astype(np.int64)


def _transitions(seq: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The distinct pairs of neighbouring classes of every document, and how often each comes; sorted some at a time."""
    cells = TOTAL * TOTAL
    codes, times = [], []
    for own in np.array_split(np.arange(len(first) - 1), -(-int(first[-1]) // 200_000) or 1):  # bounded memory
        if len(own):
            at = first[own[0] : own[-1] + 2]
            line = np.insert(seq[at[0] : at[-1]], at - at[0], END).astype(np.int64)
            of = np.repeat(np.arange(len(own)) * cells, np.diff(at) + 1)  # one pair more than it has words
            pairs, n = np.unique(of + line[:-1] * TOTAL + line[1:], return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(1, len(own)) * cells)
            codes += np.split((pairs % cells).astype(np.int32), cuts)
            times += np.split(n.astype(np.int32), cuts)
    return codes, times


def _reduce(names, classes):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "no_id", "train", "n_tokens", "n_known", "log_counts", "codes", "times", "kinds", "masses", "moves"]
        if not len(docs):
            return pd.DataFrame(columns=columns)
        train, texts = _texts(docs)
        h, first = _tokens(texts)
        words, code = _distinct(h)
        del h
        parts, totals, sizes = _answers(answers)
        new = np.concatenate([np.unpackbits(np.frombuffer(C.unpack(x), np.uint8))[:n] for x, n in zip(parts["new"], sizes)]).astype(bool) if len(sizes) else np.zeros(0, bool)
        placed = np.zeros(len(words), np.uint8)
        placed[_rare(totals)] = np.frombuffer(b"".join(C.unpack(x) for x in parts["placed"] if x is not None), np.uint8)
        own = names.value
        s = _symbols(own, words)
        own_classes = classes.value[:-2]
        kind, left_out = _classes(s, totals, own_classes, placed), _classes(s, totals - 1, own_classes, placed)
        # Distinct known words of each class that this block is the first to name, and their tokens.
        first_named = new & (totals > 0)
        kinds = np.bincount(kind[first_named], minlength=TOTAL)
        masses = np.bincount(kind[first_named], weights=totals[first_named], minlength=TOTAL).astype(np.int64)
        # Class transitions of the block's training texts, each word counted as if its own occurrence were not there:
        # what is seen once teaches how often unseen words come.
        line = np.insert(left_out.astype(np.uint8)[code], first, END).astype(np.int32)
        inside = np.insert(np.repeat(train, np.diff(first)), first, np.append(train, False))
        inside = inside[:-1]  # a pair belongs to the text that its first symbol, or the end before it, opens
        moves = np.bincount((line[:-1] * TOTAL + line[1:])[inside], minlength=TOTAL * TOTAL)
        del line, inside
        logs = np.log10(totals + ADD)[code]
        known = np.append(0, np.cumsum((totals > 0)[code]))[first]
        none = [None] * (len(docs) - 1)
        found = (docs["doc_id"].to_numpy(), docs["no_id"].to_numpy(), train, np.diff(first) + 1, np.diff(known), [float(logs[a:b].sum()) for a, b in zip(first[:-1], first[1:])])
        found += *_transitions(kind.astype(np.uint8)[code], first), [kinds, *none], [masses, *none], [moves, *none]
        return pd.DataFrame(dict(zip(columns, found)))

    return run


@dataclass(frozen=True)
class Totals:
    """Corpus-wide figures: tokens, distinct tokens, end tokens, and the two parts of a score by class pair."""

    tokens: int
    distinct: int
    ends: int
    step: np.ndarray  # log10 P(class | class before) + log10 of 1 / the class's emission denominator


def totals(reduced: DataFrame) -> Totals:
    """Sums over the training documents: at most one number for each pair of classes reaches the driver."""
    own = reduced.where("train")
    head = own.agg(F.sum("n_tokens"), F.count("*")).first()
    tokens, ends = int(head[0] or 0), int(head[1])
    sums = {}
    for c, size in (("kinds", TOTAL), ("masses", TOTAL), ("moves", TOTAL * TOTAL)):
        sums[c] = np.zeros(size)
        for r in reduced.where(F.col(c).isNotNull()).select(F.posexplode(c).alias("k", "n")).where("n > 0").groupBy("k").agg(F.sum("n").alias("n")).collect():
            sums[c][r["k"]] = r["n"]
    moves, kinds, masses = sums["moves"].reshape(TOTAL, TOTAL), sums["kinds"], sums["masses"]
    kinds[END], masses[END] = min(ends, 1), ends
    distinct = int(kinds.sum())
    after, mass = moves.sum(1), moves.sum(0)
    unigram = (mass + ADD) / (mass.sum() + ADD * TOTAL)
    chance = (moves + BACKOFF * unigram[None, :]) / (after[:, None] + BACKOFF)
    # P(word | class) = (c + 0.5) / sum of the same over the class's words; unseen words are one word.
    return Totals(tokens, distinct, ends, np.log10(chance) - np.log10(masses + ADD * np.maximum(kinds, 1))[None, :])


def class_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Learns from rows whose crc32(doc_id as text) mod 5 is not 1 (rows without id included). Null is the empty text:
    its only token is the end. Repeated rows count and are scored each. An empty table gives an empty result. The
    score is the model's log10 probability of the text, base_score that of smoothed word counts.
    """
    spark = docs.sparkSession
    train = F.coalesce(C.crc_mod("doc_id", 5) != 1, F.lit(True))
    own = C.keyed(docs, "text", train.alias("train"))
    blocks = C.block_count(docs)
    buckets = 1 << max(0, (blocks - 1).bit_length())
    blocked = own.withColumn("blk", C.block_of(blocks))
    asked = blocked.groupBy("blk").applyInPandas(_count(buckets), "blk long, bucket long, words binary, counts binary")
    told = C.cut(asked.groupBy("bucket").applyInPandas(_answer, TOLD), "class-lm-words")
    named = told.where("top is not null").select("top", "top_n").collect()
    names, counts = (np.frombuffer(b"".join(r[c] for r in named), kind) for c, kind in (("top", np.uint64), ("top_n", np.int64)))
    order = np.argsort(names, kind="stable")
    names, counts = names[order], counts[order]
    sent = spark.sparkContext.broadcast(names)
    parts = max(1, min(buckets, len(names)))
    pairs = C.cut(own.mapInPandas(_bigrams(sent, parts), PAIRS).groupBy("part").applyInPandas(_merge, MERGED), "class-lm-pairs")
    of, table = cluster(pairs, counts, parts)
    classes, moves = spark.sparkContext.broadcast(of), spark.sparkContext.broadcast(table)
    asked = blocked.groupBy("blk").cogroup(told.select("blk", "totals", "bucket").groupBy("blk")).applyInPandas(_contexts(sent, classes), "blk long, bucket long, words binary, times binary, around binary")
    placed = asked.groupBy("bucket").applyInPandas(_place(moves), "blk long, bucket long, placed binary")
    told = told.select("blk", "totals", "new", "bucket").join(placed, ["blk", "bucket"], "left")
    reduced = C.cut(blocked.groupBy("blk").cogroup(told.groupBy("blk")).applyInPandas(_reduce(sent, classes), REDUCED), "class-lm")
    t = totals(reduced)
    steps = spark.sparkContext.broadcast(t.step.ravel())
    # c of the end token is the number of training texts.
    end = float(np.log10(t.ends + ADD))
    floor = float(np.log10(t.tokens + ADD * (t.distinct + 1)))

    def score(batches):
        step = steps.value
        for pdf in batches:
            logs = pdf["log_counts"].to_numpy() + end
            moved = np.array([float((step[np.asarray(c)] * np.asarray(n)).sum()) for c, n in zip(pdf["codes"], pdf["times"])])
            n = pdf["n_tokens"].to_numpy()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "no_id": pdf["no_id"], "train": pdf["train"], "n_tokens": n, "n_known": pdf["n_known"] + (t.ends > 0), "base_score": logs - n * floor, "score": logs + moved})

    scored = reduced.select("doc_id", "no_id", "train", "n_tokens", "n_known", "log_counts", "codes", "times")
    scored = scored.mapInPandas(score, "doc_id long, no_id boolean, train boolean, n_tokens long, n_known long, base_score double, score double").withColumn("doc_id", C.doc_id())
    held_out = F.coalesce(C.crc_mod("doc_id", 5) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(t.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the training folds and score all of ``documents``."""
    return class_scores(C.table(spark, sf_dir, "documents"))
