import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import toxicity as T


def recursive(scores, base=0):
    """Maximal scoring segments by definition: the best segment, then left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or (total, i - j) > (best[2], best[0] - best[1] + 1)):
                best = (i, j + 1, total)
    if best is None:
        return []
    i, j, s = best
    return recursive(scores[:i], base) + [(i + base, j + base, s)] + recursive(scores[j:], base + j)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5).filter(bool), max_size=14))
def test_segments_are_the_maximal_ones(scores):
    got = T.segments([float(x) for x in scores])
    assert sum(s for _, _, s in got) == sum(s for _, _, s in recursive(scores))
    assert max((s for _, _, s in got), default=0) == max((s for _, _, s in recursive(scores)), default=0)
    for a, b, s in got:
        assert s == sum(scores[a:b]) > 0
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def corpus(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeorst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    bad = ["zonk", "blarg", "frib"]
    rows = []
    for i in range(n):
        toxic = int(r.random() < 0.3)
        t = [r.choice(words) for _ in range(r.randint(1, 80))]
        for _ in range(r.randint(1, 4) * toxic):
            t.insert(r.randint(0, len(t)), r.choice(bad).title() + r.choice(["", "!", "."]))
        rows.append((i, " ".join(t), toxic))
    return rows


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus(1500, 1) + [(2000, None, 0), (2001, "", 1), (2002, "... 123 !!!", 0), (2003, "zonk " * 5000, None), (2004, "Frib", None)]
    docs = spark.createDataFrame([(d, t, "score") for d, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, y, 0) for d, _, y in rows], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in T.score_toxicity(docs, T.fit(docs, labels)).collect()}
    assert len(got) == len(rows)
    for d, t, y in rows:
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        for p in r.passages:
            assert any(w in t.encode()[p.start : p.end].decode().lower() for w in ("zonk", "blarg", "frib"))
    held = [(y, got[d].predicted) for d, _, y in rows if got[d].held_out and y is not None and d < 2000]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert got[2003].predicted == got[2004].predicted == 1
    assert got[2000].predicted == got[2001].predicted == got[2002].predicted == 0


def words_of(text):
    return re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode().lower())


def brute(train, texts):
    """Scores by the words of the module: distinct contexts, log-odds less two standard errors, best segments, curve."""
    once = dict(train)
    contexts = {0: set(), 1: set()}
    for t, y in once.items():
        w = [None, *words_of(t), None]
        contexts[y] |= {tuple(w[i - 1 : i + 2]) for i in range(1, len(w) - 1)}
    count = {y: Counter(c[1] for c in contexts[y]) for y in (0, 1)}
    count[0][None] = 1  # the unseen token
    size = {y: sum(count[y].values()) for y in (0, 1)}
    prior = lambda w: T.PRIOR * (count[0][w] + count[1][w])
    weight = sum(prior(w) for w in {*count[0], *count[1]} - {None})
    scores = {}
    for w in {*count[0], *count[1]}:
        a, b = count[1][w] + prior(w), count[0][w] + prior(w)
        odds = math.log(a / (size[1] + weight - a)) - math.log(b / (size[0] + weight - b))
        scores[w] = odds - T.CAUTION * math.sqrt(1 / a + 1 / b)

    def described(text):
        own = words_of(text)
        line = [0.0 if i and own[i - 1] == w else scores.get(w, scores[None]) for i, w in enumerate(own)]
        return len(own), [s for _, _, s in T.segments(line)]

    clean = [described(t) for t, y in once.items() if not y]
    place, slope, scale = T.gumbel(np.array([n for n, _ in clean], float), np.array([max(s, default=0.0) for _, s in clean]))

    def evidence(text):
        n, found = described(text)
        tails = [1 - math.exp(-math.exp(-(s - place - slope * math.log(n + 1)) / scale)) for s in found]
        return math.log1p(sum(max(0.0, -math.log(max(p, 1e-300)) - T.SIGNIFICANT) for p in tails))

    bias, curve = T._logistic(np.array([evidence(t) for t in once]), np.array(list(once.values()), float))
    return [1 / (1 + math.exp(-(bias + curve * evidence(t)))) for t in texts]


def test_scores_against_brute_force(spark):
    rows = corpus(250, 4)
    texts = [t for _, t, _ in rows] + [None, "", "zonk zonk zonk blarg", "é frib É", "unseen words only"]
    docs = spark.createDataFrame([*[(d, t) for d, t, _ in rows], *[(1000 + i, t) for i, t in enumerate(texts[250:])], (None, "a zonk")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in T.score_toxicity(docs, T.fit(docs.unionByName(docs), labels)).collect()}
    want = brute([(t, y) for d, t, y in rows if zlib.crc32(str(d).encode()) % 5], texts)
    assert all(abs(got[d] - w) < 1e-4 for d, w in zip([*range(250), *range(1000, 1005)], want))
    assert len({round(w, 6) for w in want}) > 5


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.score_toxicity(docs, T.fit(docs, none)).collect()
    assert [r.predicted for r in got] == [0, 0] and {r.held_out for r in got} == {False}
    assert T.score_toxicity(docs.limit(0), T.fit(docs, none)).collect() == []


def test_training_holds_neither_all_texts_nor_all_contexts():
    r = random.Random(8)
    words = ["".join(r.choice("abcdeorst") for _ in range(r.randint(2, 8))) for _ in range(3000)]

    def rows():
        for i in range(600):
            yield i, " ".join(r.choices(words, k=5000) + ["zonk"] * (i % 7 == 0)).encode()

    tracemalloc.start()
    try:
        size = sum(len(t) for _, t in rows())
        tracemalloc.reset_peak()
        model = T.train((t for _, t in rows()), [int(i % 7 == 0) for i in range(600)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.hashes) > 2000 and model.weight > 0
    assert peak < 2.5 * size
