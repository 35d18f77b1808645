import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from recordloom.llm import class_lm as L


def corpus(n=160):
    r = random.Random(5)
    words = ["".join(r.choice("abcdéZ") for _ in range(r.randint(1, 6))) for _ in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    rows = [(i * 3, " ".join(r.choices(words, weights, k=r.choice([0, 1, 5, 40, 200])))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, "Never seen\tbefore\n"), (1003, "a " * 5000), (rows[3]), (None, "b c")]


def words_of(t):
    return [w.decode() for w in (t or "").encode().lower().split()]


def base(rows):
    counts = Counter()
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1]
    for _, t in train:
        counts.update([*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    return counts, n, v


@pytest.mark.parametrize("blocks", [1, 4])
def test_counts_base_and_model(spark, monkeypatch, blocks):
    rows = corpus()
    monkeypatch.setattr(L, "WORDS", 30)
    monkeypatch.setattr(L.C, "block_count", lambda *_: blocks)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    got = sorted(L.class_scores(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    counts, n, v = base(rows)
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(want)
    for r, (d, t) in zip(got, want):
        tokens = [*words_of(t), None]
        assert (r.doc_id, r.n_tokens, r.train_tokens) == (d, len(tokens), n)
        assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 5 == 1)
        assert r.n_known == sum(counts[w] > 0 for w in tokens)
        assert abs(r.base_score - sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)) < 1e-6 * len(tokens)
        assert r.score < 0


def by_words(rows, class_of):
    """Scores by the words of the module for given classes of exchanged words: placing, transitions, emissions."""
    texts = {i: words_of(t) for i, (_, t) in enumerate(rows)}
    train = [i for i, (d, _) in enumerate(rows) if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    count = Counter(w for i in train for w in texts[i])
    exchanged = {w: class_of(w) for w in count if count[w] >= L.FLOOR}
    first = lambda w: exchanged.get(w, L.UNSEEN)
    table, around = np.zeros((L.TOTAL, L.TOTAL)), {}
    for i in train:
        line = [L.END, *map(first, texts[i]), L.END]
        for a, b in itertools.pairwise(line):
            table[a, b] += 1
        for k, w in enumerate(texts[i]):
            around.setdefault(w, []).append((line[k], line[k + 2]))
    t = table + L.ADD
    fit = lambda w, c: sum(math.log(t[a, c]) + math.log(t[c, b]) - math.log(t[c].sum()) - math.log(t[:, c].sum()) for a, b in around[w])
    kind = {w: exchanged[w] if w in exchanged else max(range(L.CLASSES), key=lambda c: fit(w, c)) for w in count}
    moves = np.zeros((L.TOTAL, L.TOTAL))
    for i in train:
        line = [L.END, *(kind[w] if count[w] > 1 else L.UNSEEN for w in texts[i]), L.END]
        for a, b in itertools.pairwise(line):
            moves[a, b] += 1
    words, mass = Counter(kind.values()), Counter()
    for w in count:
        mass[kind[w]] += count[w]
    words[L.END], mass[L.END] = 1, len(train)
    share = (moves.sum(0) + L.ADD) / (moves.sum() + L.ADD * L.TOTAL)
    out = []
    for i in texts:
        total, a = 0.0, L.END
        for w in [*texts[i], None]:
            b = L.END if w is None else kind.get(w, L.UNSEEN)
            c = len(train) if w is None else count[w]
            total += math.log10((moves[a, b] + L.BACKOFF * share[b]) / (moves[a].sum() + L.BACKOFF))
            total += math.log10((c + L.ADD) / (mass[b] + L.ADD * max(words[b], 1)))
            a = b
        out.append(total)
    return out


@pytest.mark.parametrize("blocks", [1, 3])
def test_scores_against_brute_force(spark, monkeypatch, blocks):
    rows = [r for r in corpus(90) if r[0] != 1003]

    def cluster(pairs, totals, parts):
        of = np.append([int(h) % 4 for h in hashes], [L.UNSEEN, L.END]).astype(np.uint8)
        return of, L._table(pairs, of, L.TOTAL)

    train = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    h, _ = L._tokens([L.C.as_bytes(t) for t in train])
    found, n = np.unique(h, return_counts=True)
    hashes = found[n >= L.FLOOR]
    monkeypatch.setattr(L, "cluster", cluster)
    monkeypatch.setattr(L.C, "block_count", lambda *_: blocks)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place int")
    got = sorted(((str(r.doc_id), r.n_tokens, r.score) for r in L.class_scores(df).collect()))
    class_of = lambda w: int(L._tokens([w.encode()])[0][0]) % 4
    want = sorted((str(d), len(words_of(t)) + 1, s) for (d, t), s in zip(rows, by_words(rows, class_of)))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-6 * max(1, abs(w[2])) for g, w in zip(got, want))


def test_model_beats_the_base_on_text_with_structure(spark):
    r = random.Random(9)
    nouns, verbs = [f"n{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    rows = [(i, " ".join(w for _ in range(20) for w in (r.choice(nouns), r.choice(verbs)))) for i in range(400)]
    got = L.class_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(x.score for x in got) > sum(x.base_score for x in got) * 0.95


def test_exchange_is_a_local_optimum():
    r = np.random.default_rng(2)
    pairs = r.integers(0, 6, (9, 9)).astype(float)
    k = 3
    of = L.exchange(pairs, k, 50)

    def value(assign):
        m = np.zeros((9, k + 2))
        m[np.arange(9), [*assign, k, k + 1]] = 1
        t = m.T @ pairs @ m
        x = lambda a: float(np.where(a > 0, a * np.log(np.maximum(a, 1e-300)), 0).sum())
        return x(t) - x(t.sum(1)) - x(t.sum(0))

    for w, d in itertools.product(range(7), range(k)):
        other = of.copy()
        other[w] = d
        assert value(other) <= value(of) + 1e-6


def test_empty(spark):
    assert L.class_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("parts", [1, 30])
def test_exchanged_words_are_the_most_frequent_however_rows_are_dealt(spark, monkeypatch, parts):
    """In every document 4,100 words are ahead of "z", but not in all of them together."""
    rows = [(i, " ".join([f"w{i}_{j}" for j in range(4100)] * 2 + ["z"])) for i in range(30)]
    monkeypatch.setattr(L, "WORDS", 1)
    monkeypatch.setattr(L.C, "block_count", lambda *_: 7)
    seen = []
    whole = L.exchange
    monkeypatch.setattr(L, "exchange", lambda pairs, *a: seen.append(pairs) or whole(pairs, *a))
    L.class_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    train = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows)
    assert seen[0][0].sum() == train


def test_all_words_from_the_floor_are_exchanged_and_rarer_ones_placed(spark, monkeypatch):
    """Nouns and verbs take turns: beyond the first 100 words they keep apart in classes only if they are exchanged."""
    r = random.Random(4)
    nouns, verbs = [f"n{i}" for i in range(700)], [f"v{i}" for i in range(700)]
    rows = [(i, " ".join(w for _ in range(100) for w in (r.choice(nouns), r.choice(verbs)))) for i in range(500)]
    rows += [(1000 + i, f"{r.choice(nouns)} rare{i % 3} {r.choice(nouns)}") for i in range(12)]
    monkeypatch.setattr(L, "WORDS", 100)
    monkeypatch.setattr(L.C, "block_count", lambda *_: 5)
    kept = {}
    whole, reduce = L.cluster, L._reduce
    monkeypatch.setattr(L, "cluster", lambda *a: kept.setdefault("of", whole(*a)))
    monkeypatch.setattr(L, "_reduce", lambda names, of: kept.setdefault("names", names.value) is None or reduce(names, of))
    got = {x.doc_id: x for x in L.class_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of, table = kept["of"]
    assert len(of) == 1400 + 2 and (of[:-2] < L.CLASSES).all()
    sides = []
    for side in (nouns, verbs):
        h, _ = L._tokens([" ".join(side).encode()])
        sides.append(np.bincount(of[np.searchsorted(kept["names"], h)], minlength=L.CLASSES))
    assert np.minimum(*sides).sum() < 0.02 * 1400  # words in a class of mostly the other kind
    assert got[1000].score > got[1000].base_score - 5


def test_best_class_is_the_best_of_all(monkeypatch):
    r = np.random.default_rng(3)
    words, k = 12, 4
    monkeypatch.setattr(L, "CLASSES", k)
    pairs = r.integers(0, 5, (words + 2, words + 2)).astype(float)
    of = np.append(r.integers(0, k, words), [k, k + 1])
    of[:2] = k

    def table(assign):
        m = np.zeros((words + 2, k + 2))
        m[np.arange(words + 2), assign] = 1
        return m, m.T @ pairs @ m

    member, now = table(of)
    selves = np.diag(pairs)[:words]
    bare = pairs - np.diag(np.diag(pairs))
    best = L.best_classes(of[:words], now, (bare @ member)[:words], (bare.T @ member)[:words], selves)
    for w in range(words):
        values = [L.likelihood(table(np.where(np.arange(words + 2) == w, d, of))[1]) for d in range(k)]
        assert values[best[w]] >= max(values) - 1e-6


def test_rare_words_go_where_their_contexts_are_likeliest(monkeypatch):
    table = np.ones((L.TOTAL, L.TOTAL))
    table[3, 7] = table[7, 5] = 1000

    class Sent:
        value = table

    asked = [(b, 0, np.array([11, 12], np.uint64).tobytes(), L.C.pack(np.array([1, 0], np.uint8).tobytes()), L.C.pack(np.array([[3, 5]], np.uint8).tobytes())) for b in (0, 1)]
    got = L._place(Sent)(L.pd.DataFrame(asked, columns=["blk", "bucket", "words", "times", "around"]))
    assert [L.C.unpack(x)[0] for x in got["placed"]] == [7, 7]


def test_logs_of_the_table_are_taken_once(monkeypatch):
    """A step takes logarithms of changed cells; the table's own are not taken again for every word."""
    rng = np.random.default_rng(3)
    of, table = rng.integers(0, L.CLASSES, 200), rng.integers(1000, 9000, (L.TOTAL, L.TOTAL)).astype(float)
    after, before = rng.integers(1, 4, (2, 200, L.TOTAL)).astype(float)
    taken, real = [], L._xlogx
    monkeypatch.setattr(L, "_xlogx", lambda x: taken.append(np.size(x)) or real(x))
    L.best_classes(of, table, after, before, np.ones(200))
    assert sum(taken) < 1.3 * 2 * 200 * L.TOTAL * L.CLASSES


def test_words_with_the_same_count_beside_a_class_share_its_logs(monkeypatch):
    rng = np.random.default_rng(3)
    of, table = rng.integers(0, L.CLASSES, 200), rng.integers(1000, 9000, (L.TOTAL, L.TOTAL)).astype(float)
    after, before = rng.integers(1, 4, (2, 200, L.TOTAL)).astype(float)
    taken, real = [], L._xlogx
    monkeypatch.setattr(L, "_xlogx", lambda x: taken.append(np.size(x)) or real(x))
    L.best_classes(of, table, after, before, np.ones(200))
    assert sum(taken) < 0.2 * 2 * 200 * L.TOTAL * L.CLASSES


def test_pairs_are_packed_in_few_bytes_and_read_back_exactly():
    rng = np.random.default_rng(4)
    for first, gap, most in ((0, 200, 200), (1 << 40, 60_000, 3), (7, 1 << 34, 1 << 40)):
        code = first + np.cumsum(rng.integers(1, gap, 1000))
        n = rng.integers(1, most, 1000)
        packed = L._packed(code, n)
        assert all((a == b).all() and a.dtype == np.int64 for a, b in zip(L._unpacked(*packed), (code, n)))
        assert len(L._wide(packed[0][8:])) == 999 and len(L._wide(packed[1])) == 1000
        assert L._wide(packed[0][8:]).itemsize == np.min_scalar_type(gap - 1).itemsize
        assert L._wide(packed[1]).itemsize == np.min_scalar_type(most - 1).itemsize
    for k in (0, 1):
        assert [x.tolist() for x in L._unpacked(*L._packed(np.arange(5, 5 + k), np.arange(9, 9 + k)))] == [[5][:k], [9][:k]]


def test_distinct_words_are_sorted_and_found():
    h = np.random.default_rng(5).integers(0, 50, 1000).astype(np.uint64) << np.uint64(58)
    for x in (h, h[:1], h[:0]):
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(L._distinct(x), np.unique(x, return_inverse=True)))


def test_the_table_of_classes_reads_no_pair_twice(spark):
    """The side before the words lists pairs again: of it the table takes only the two last symbols before words."""
    texts = ["a b a c", "z a", "b c", ""]
    names, _ = L._distinct(L._tokens([b"a b c"])[0])

    class Sent:
        value = names

    rows = pd.concat(L._bigrams(Sent, 2)(iter([pd.DataFrame({"text": texts, "train": True})])))
    merged = spark.createDataFrame(pd.concat(map(lambda g: L._merge(g[1]), rows.groupby("part"))), L.MERGED)
    sides = [c for c in merged.columns if not c.startswith("back")]
    of = np.arange(5, dtype=np.uint8)
    line = [4, *(x for t in texts for x in [*L._symbols(names, L._tokens([t.encode()])[0]).tolist(), 4])]
    want = np.zeros((5, 5))
    np.add.at(want, (line[:-1], line[1:]), 1)
    assert (L._table(merged.select(*sides), of, 5) == want).all()
