import hashlib
import random

import pytest

from recordloom.llm import order_minhash as O


def plain(text):
    """The definition, k-mer by k-mer, over the same k-mer hashes."""
    h = [int(x) for x in O.kmer_hashes(text)]
    out = []
    for odd, add in zip(O._ODD.tolist(), O._ADD.tolist()):
        ranked = sorted(range(len(h)), key=lambda i: ((v := (h[i] * odd + add) % 2**64) ^ v >> 32, i))[: O.TUPLE]
        acc = add
        for i in sorted(ranked):
            acc = int(O.C.mix(O.np.array([(acc * 3 + h[i]) % 2**64], O.np.uint64))[0])
        out.append(acc >> 32)
    return out


def test_signature_is_the_definition():
    r = random.Random(2)
    for n in (0, 1, 7, 8, 9, 50, 300):
        text = "".join(r.choice("ab é") for _ in range(n))
        assert O.signature(text).tolist() == plain(text) == O.signature(text, part=16).tolist()


def test_occurrences_count_and_order_matters():
    a, b = "abcdefgh" * 40, "abcdefgh" * 80
    assert len(set(O.kmer_hashes(a).tolist())) == len(O.kmer_hashes(a))
    assert O.likeness(O.signature(a), O.signature(b)) < 1
    r = random.Random(4)
    x, y = ("".join(r.choice("abcdefgh ") for _ in range(2000)) for _ in "ab")
    swapped = O.likeness(O.signature(x + y), O.signature(y + x))
    edited = O.likeness(O.signature(x + y), O.signature(x + y[:-200]))
    assert swapped < edited


@pytest.mark.parametrize("parts", [1, 3])
def test_table(spark, monkeypatch, parts):
    r = random.Random(7)
    rows = [(i * 3, "".join(r.choice("abcdé🎉 ") for _ in range(r.choice([0, 3, 20, 400])))) for i in range(30)]
    rows += [(4, None), (5, rows[3][1]), (None, "last one here"), (7, "x" * 20000)]
    monkeypatch.setattr(O.C, "block_count", lambda *_: parts)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, pid int")
    got = {x.doc_id: x for x in O.order_minhash(df).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    for (d, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1]):
        t, nxt = t or "", nxt or ""
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        x = got[d]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert x.fingerprint == O._shown(O.signature(t)) and x.edited_fingerprint == O._shown(O.signature(edited))
        assert x.near_edited == O.likeness(O.signature(t), O.signature(edited))
        assert x.near_next == O.likeness(O.signature(t), O.signature(nxt))


def test_one_and_none(spark):
    one = O.order_minhash(spark.createDataFrame([(1, "just one document")], "doc_id long, text string")).collect()
    assert [(x.near_next, x.n_chars) for x in one] == [(1.0, 17)]
    assert O.order_minhash(spark.createDataFrame([], "doc_id long, text string")).collect() == []
