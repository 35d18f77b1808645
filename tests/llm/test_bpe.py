import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from recordloom.llm import bpe

OWN = bpe.Tokenizer(bpe.read_definition(bpe.default_path()))
LIBRARY = Library.from_file(bpe.default_path())


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = OWN.encode(text).tolist()
    assert got == want, text
    assert OWN.decode(np.array(got, np.uint32)).decode("utf-8", "replace") == LIBRARY.decode(want, skip_special_tokens=False)


def test_fixed_texts():
    for text in ["", " ", "\n\n  x", "Hello world's <|endoftext|> end", "<|endoftext|><|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "éàü ß 漢字 🎉🎉", "\x1c\x1d a\x85b\xa0c", "12345 6,7", "=" * 500, "antidisestablishmentarianism" * 9, "'s't 'll'x", "a​b 　 c"]:
        same(text)


def test_random_words():
    r = random.Random(1)
    for _ in range(300):
        same("".join(r.choice("the nda eoirs.,\n'éß0") for _ in range(r.randint(0, 200))))


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(blacklist_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(text):
    same(text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 4)
    same("one two three four five six one two three " * 3)


def test_table(spark):
    df = spark.createDataFrame([(1, "ab cd", "x"), (2, None, "y"), (1, "ab cd", "x"), (None, "", "z")], "doc_id long, text string, n_tokens string")
    got = bpe.bpe_encode(df).collect()
    ids = LIBRARY.encode("ab cd", add_special_tokens=False).ids
    empty = hashlib.sha256(b"").hexdigest()
    full = (1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"ab cd").hexdigest())
    assert sorted(map(tuple, got), key=str) == sorted([full, full, (2, 0, empty, empty), (None, 0, empty, empty)], key=str)
    assert bpe.bpe_encode(df.limit(0)).collect() == []
    assert {tuple(r.ids) for r in bpe.bpe_encode(df, with_ids=True).collect()} == {tuple(ids), ()}
