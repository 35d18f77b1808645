import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from recordloom.llm import suffix_dedup as S


def brute(rows):
    """(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, sha) by a table of all 50-byte strings."""
    inf = float("inf")
    key = lambda d: inf if d is None else d
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            least[w] = min(least.get(w, inf), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < key(d):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def planted(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (9, 12, 30, 100)]
    rows = [(i, prose(r.randint(0, 120)) + " " + r.choice(shared) + prose(r.randint(0, 50))) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1]) for i in range(20)]
    rows += [(200 + i, rows[3][1][: 40 * i]) for i in range(8)]
    rows += [(300, None), (301, ""), (302, "a" * 200), (303, "a" * 120 + "b"), (304, "ab" * 90), (None, rows[0][1]), (305, "x" * 49), (306, "x" * 50), (307, "x" * 50)]
    rows += [(5, rows[5][1]), (310, "\x00" * 80), (311, "\x00" * 60 + "q"), (312, prose(3000)), (313, "z " + rows[2][1] + " " + rows[3][1])]
    return rows


@pytest.mark.parametrize("blocks", [1, 5])
def test_against_brute_force(spark, monkeypatch, blocks):
    rows = planted(blocks)
    monkeypatch.setattr(S.C, "block_count", lambda *_: blocks)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, blk string, n int")
    got = [tuple(r) for r in S.suffix_dedup(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def by_hand(rows, blocks):
    """The stages one after the other, without Spark."""
    df = pd.DataFrame(rows, columns=["doc_id", "text"])
    df["blk"] = [sum(map(ord, str(d))) % blocks for d in df["doc_id"]]
    df["no_id"] = df["doc_id"].isna()
    df["doc_id"] = df["doc_id"].fillna(0).astype(np.int64)
    parts = [g for _, g in df.groupby("blk")]
    sent = pd.concat([S._send_hashes(4)(b) for b in parts])
    back = pd.concat([S._repeated(g) for _, g in sent.groupby("bucket")])
    runs = pd.concat([S._make_run(b, back[back["blk"] == b["blk"].iloc[0]]) for b in parts])
    pieces = pd.concat(list(S._cut_runs([b"h", b"q"])([runs])))
    answers = pd.concat([S._merge_part(g) for _, g in pieces.groupby("part")])
    out = []
    for b in parts:
        told = answers[answers["blk"] == b["blk"].iloc[0]].assign(pos=None, item=None, n=np.nan)
        out.append(S._strip(b, pd.concat([told, runs[runs["blk"] == b["blk"].iloc[0]][["blk", "n", "pos", "item"]]])))
    return sorted([(None if r[1] else int(r[0]), *r[2:6]) for r in pd.concat(out).itertuples(index=False)], key=str)


@pytest.mark.parametrize("few", [1, 8])
def test_few_and_many_keys_of_an_anchor(monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    for seed in (1, 5, 9):
        assert by_hand(planted(seed), 4) == brute(planted(seed))


def test_empty_table(spark):
    assert S.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_text_of_what_is_left(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(26)) * 3
    got = {r.doc_id: r.kept_text for r in S.suffix_dedup(spark.createDataFrame([(1, text), (2, "head " + text)], "doc_id long, text string"), True).collect()}
    assert got == {1: text, 2: "head "}


def test_front_coding_and_merge_are_exact():
    r = np.random.default_rng(3)
    runs = []
    for n in (0, 1, 40, 300):
        keys = r.integers(97, 99, (n, S.KEY), np.uint8)
        keys = keys[S._order(keys)]
        runs.append(S.front_decode(n, S.front_code(keys)))
        assert runs[-1][1] == sorted(x.tobytes() for x in keys)
    last, seen = None, []
    for i, p, h in S.merge(runs):
        key = runs[i][1][p]
        if last is not None:
            assert h == next((j for j in range(S.KEY) if key[j] != last[j]), S.KEY)
        last = key
        seen.append(key)
    assert seen == sorted(k for _, keys in runs for k in keys)


def test_every_window_has_a_selected_gram():
    r = np.random.default_rng(5)
    buf = r.integers(97, 100, 700, np.uint8)
    at, _ = S.anchors(buf, np.array([0, 30, 79, 129, 129, 700]))
    chosen = set(at.tolist())
    for a, b in ((79, 129), (129, 700)):
        for x in range(a, b - 49):
            assert any(p in chosen for p in range(x, x + S.OFFSETS))
    assert all(p >= 79 for p in chosen)
