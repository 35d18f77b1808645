import random

import numpy as np
import pytest

from recordloom.llm import near_dedup as N


def shingles(text):
    words = [bytes(w) for w in (text or "").encode().lower().split()]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            (a, b), (d, e) = (sets[i], sets[j]), (rows[i][0], rows[j][0])
            if d is None or e is None:
                continue
            if (a and b and 100 * len(a & b) >= 75 * len(a | b)) or (d == e and a and b):
                top[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min((rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and root(j) == root(i)), default=None) if d is not None and sets[i] else d
        out.append((d, len(sets[i]), c, True if d is None else d == c))
    return sorted(out, key=str)


def planted(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéA") for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(40):
        base = [word() for _ in range(r.choice([1, 3, 5, 12, 60, 200]))]
        for k in range(r.randint(1, 7)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = word()
            rows.append((1000 - len(rows) * 3, r.choice([" ", "\n", " \t"]).join(copy)))
    drift = [word() for _ in range(120)]
    for i in range(12):  # a chain: neighbours are near, ends are not
        rows.append((2000 + i, " ".join(drift)))
        drift[i * 9 : i * 9 + 3] = [word() for _ in range(3)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "One two"), (3004, "one  TWO"), (3005, "x " * 5000), (3006, "x " * 9000), (None, rows[0][1]), (rows[0][0], rows[0][1]), (3007, rows[1][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(N, "CHUNK", 2)
        monkeypatch.setattr(N, "SLAB", 16)
    rows = planted(seed)
    df = spark.createDataFrame([(d, t, 5, "k") for d, t in rows], "doc_id long, text string, n int, key string")
    assert sorted((tuple(x) for x in N.near_duplicates(df).collect()), key=str) == brute(rows)


def test_chunks_meet_like_all_pairs():
    r = np.random.default_rng(4)
    base = r.integers(0, 2**62, 400)
    sets = [np.unique(np.concatenate([r.choice(base, r.integers(40, 60), False), base[:150]])) for _ in range(20)]
    sets += [sets[0], sets[1][:-5]]
    rows = [(i, i % 3, i % 2, s) for i, s in enumerate(sets)]
    want = set()
    for i, (a, ca, _, x) in enumerate(rows):
        for b, cb, _, y in rows[i + 1 :]:
            both = len(np.intersect1d(x, y))
            if ca != cb and 100 * both >= 75 * (len(x) + len(y) - both):
                want.add((a, b))
    import pandas as pd

    got = set()
    for lo, hi in ((0, 0), (0, 1), (1, 1)):
        part = [(*row, 0, 0, lo, hi, row[2] == lo) for row in rows if row[2] in (lo, hi)]
        out = N._linked_chunks(pd.DataFrame(part, columns=["class", "component", "chunk", "items", "g", "h", "lo", "hi", "left"]))
        got |= set(map(tuple, out.to_numpy().tolist()))
    # as many links as connect the components, all of them true
    def joined(links):
        top = {c: c for c in range(3)}
        for a, b in links:
            x, y = top[a % 3], top[b % 3]
            top = {c: (x if t == y else t) for c, t in top.items()}
        return {frozenset(c for c in top if top[c] == t) for t in top.values()}

    assert got <= want and len(got) <= 6 and joined(got) == joined(want)


def test_links_across_size_groups(spark, monkeypatch):
    """One bucket for all: every link has to come from the search across components, whatever the sizes."""
    monkeypatch.setattr(N, "CHUNK", 3)
    monkeypatch.setattr(N, "band_keys", lambda c: np.arange(1, dtype=np.uint64))
    words = [f"w{i}" for i in range(2000)]
    rows = [(100, "z")]
    for i, n in enumerate([9, 10, 12, 13, 16, 17, 22, 23, 30, 31, 40, 41, 54, 55]):
        text = words[40 * (i // 2) : 40 * (i // 2) + 4 + n] if i % 4 < 2 else words[1000 : 1004 + n]
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in N.near_duplicates(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_coordinate_fills_and_agreement_estimates_similarity():
    r = np.random.default_rng(1)
    for n in (1, 2, 10, 1000):
        assert (N.sketch(r.integers(0, 2**63, n).astype(np.uint64)) < np.uint64(2**64 - 1)).all()
    off = []
    for j in (0.3, 0.5, 0.75, 0.9):
        for n in (40, 400):
            x = r.integers(0, 2**63, 2 * n).astype(np.uint64)
            both = round(2 * n * j / (1 + j))
            own = (2 * n - 2 * both) // 2 if both * 2 < 2 * n else 0
            a, b = x[: both + own], np.concatenate([x[:both], x[both + own : both + 2 * own]])
            true = both / (both + 2 * own)
            off.append(abs((N.sketch(a) == N.sketch(b)).mean() - true))
    assert max(off) < 0.2 and sum(off) / len(off) < 0.06
