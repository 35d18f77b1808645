import random
import tracemalloc
import zlib

import numpy as np

from recordloom.llm import language as L

ALPHABETS = {"aa": ["tho", "ing", "er", "the"], "bb": ["ción", "os", "que", "ll"], "cc": ["sch", "ü", "ung", "ei"]}


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(ALPHABETS))
        out.append((i, " ".join("".join(r.choice(ALPHABETS[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 60))), lang))
    return out


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus(900, 1) + [(2000, None, "aa"), (2001, "", None), (2002, "12 !! \n", "bb"), (2003, "漢字", None), (2004, "thoing " * 20000, None), (None, "schung", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in L.identify(df, L.fit(df)).collect()}
    assert len(got) == len(rows)
    for d, _, _ in rows:
        assert got[d].held_out == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= got[d].score <= 1
    held = [(lang, got[d].lang_pred) for d, _, lang in rows[:900] if got[d].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert [got[d].lang_pred for d in (2000, 2001, 2002)] == ["und"] * 3
    assert got[2003].lang_pred in ALPHABETS and got[2004].lang_pred == "aa"


def test_grams_do_not_cross_texts():
    a, b = b"abcd", b"xyz"
    buf, bounds = np.frombuffer(a + b, np.uint8), np.array([0, 4, 7])
    both, owner = L.buckets(buf, bounds)
    alone = [L.buckets(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (a, b)]
    for n in range(3):
        for k in range(2):
            assert both[n][owner[n] == k].tolist() == alone[k][n].tolist() if n < len(alone[k]) else True


def plain(model, text):
    """The probabilities by the words of the module: averaged embeddings of all n-grams, softmax, temperature."""
    shown = bytes(c if c >= 128 else c | 32 if chr(c).isalpha() else 32 for c in text.encode())
    while b"  " in shown:
        shown = shown.replace(b"  ", b" ")
    score, count = np.zeros(len(model.langs)), 0
    for n in L.GRAMS:
        for i in range(len(shown) - n + 1):
            h = n
            for c in shown[i : i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
            score += model.table[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 18].astype(float)
            count += 1
    e = np.exp((score / max(count, 1) + model.bias) / model.temperature)
    return e / e.sum()


def test_scores_against_brute_force(spark):
    rows = corpus(300, 5) + [(400 + i, t, None) for i, t in enumerate(["x", "ab", "a  b,,c 12 D", "ünder  the", "que " * 3000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df)
    got = {r.doc_id: r for r in L.identify(df, model).collect()}
    for d, t, _ in rows[::20] + rows[300:]:
        p = plain(model, t)
        assert abs(got[d].score - p.max()) < 1e-6 and got[d].lang_pred == model.langs[int(p.argmax())]
    # a repeated id is learned from once
    again = L.fit(df.unionByName(df))
    assert again.langs == model.langs and np.allclose(again.table, model.table) and again.temperature == model.temperature


def test_many_short_texts_take_little_memory(spark):
    model = L.train([t for _, t, _ in corpus(200, 3)], [x for *_, x in corpus(200, 3)])
    texts = [bytes([97 + i % 26, 97 + i % 7]) for i in range(10_000)]
    model.predict(texts[:10])
    tracemalloc.start()
    model.predict(texts)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.identify(df, L.fit(df)).collect()] == ["und"]
    assert L.identify(df.limit(0), L.fit(df)).collect() == []
