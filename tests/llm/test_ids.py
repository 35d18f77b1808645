"""Ids above 2**53 together with null ids: no operator and no stage may round them."""

import random

import pytest

import corpus_pipeline as P
from recordloom.llm import ann, bpe, class_lm, language, mixing, near_dedup, order_minhash, suffix_dedup, toxicity

BIG = [2**53 + 1, 2**53 + 3, 2**62 + 1, -(2**60) - 1, None, None, 7]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, no_id string, blk string"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdeorst") for _ in range(r.randint(2, 7))) for _ in range(200)]
    shared = " ".join(r.choice(words) for _ in range(30))
    rows = []
    for i, d in enumerate([*BIG, *range(100, 120)]):
        text = None if i == 6 else "" if i == 7 else shared if d in BIG[:2] else " ".join(r.choice(words) for _ in range(r.randint(1, 60))) + (" zonk" * (i % 3 == 0))
        rows.append((d, text, "aa" if i % 2 else "bb", "s", None if i == 3 else len(text or ""), "x", "y"))
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def ids(rows):
    return sorted((r.doc_id for r in rows), key=str)


OPERATORS = {
    "suffix_dedup": lambda d, _: suffix_dedup.suffix_dedup(d),
    "bpe": lambda d, _: bpe.bpe_encode(d),
    "language": lambda d, _: language.identify(d, language.fit(d)),
    "mixing": lambda d, _: mixing.mix(d),
    "order_minhash": lambda d, _: order_minhash.order_minhash(d),
    "near_dedup": lambda d, _: near_dedup.near_duplicates(d),
    "class_lm": lambda d, _: class_lm.class_scores(d),
    "toxicity": lambda d, labels: toxicity.score_toxicity(d, toxicity.fit(d, labels)),
}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(d, 1, i % 2) for i, d in enumerate([*BIG, *range(100, 120)]) if d is not None] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_keep_ids(docs, labels, name):
    got = OPERATORS[name](docs, labels).collect()
    assert ids(got) == ids(docs.collect())
    if name == "near_dedup":
        of = {r.doc_id: r.component_id for r in got}
        assert of[BIG[0]] == of[BIG[1]] == BIG[0] and {r.component_id for r in got} <= {r.doc_id for r in got}
    if name == "suffix_dedup":
        assert {r.doc_id: r.n_removed > 0 for r in got}[BIG[1]] and not {r.doc_id: r.n_removed for r in got}[BIG[0]]


def test_neighbours_keep_ids(spark):
    rows = [(2**53 + 1, [1.0, 2.0]), (2**53 + 3, [1.0, 2.1]), (None, [1.0, 2.0]), (50, [1.0, 1.9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    assert sorted(r.vec_id for r in ann.nearest(df, df.where("vec_id = 50")).collect()) == [2**53 + 1, 2**53 + 3]


def test_stages_keep_ids(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    own = docs.select(*P.COLUMNS)
    known = {r.doc_id for r in own.collect()}
    texts = {(r.doc_id, r.n_chars) for r in own.collect()}
    for name, stage in P.STAGES:
        got = stage(spark, own, str(tmp_path)).collect()
        assert {r.doc_id for r in got} <= known and len(got) > len(BIG)
        if name == "toxicity":
            assert {(r.doc_id, r.n_chars) for r in got} <= texts


def test_stages_on_an_empty_table(spark, labels, docs, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    none = docs.select(*P.COLUMNS).limit(0)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in P.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == []
    assert P.run(spark, str(tmp_path)).collect() == []
