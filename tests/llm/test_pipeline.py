import random

import corpus_pipeline as P
from recordloom.llm import bpe, mixing

from .test_near_dedup import brute as near_brute
from .test_suffix_dedup import brute as suffix_brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(11)
    words = ["".join(r.choice("abcdeorstié") for _ in range(r.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = prose(60)
    docs, labels = [], []
    for i in range(240):
        text = prose(r.choice([2, 10, 60, 150]))
        toxic = int(i % 6 == 0)
        for w in r.sample(["blarg", "zonk", "frib"], 3) * toxic:
            text = w + " " + text.replace(" ", f" {w} ", 1)
        if i % 9 == 1:
            text += " " + passage
        if i % 10 == 3:
            text = docs[-1][1] + (" more" if i % 20 == 3 else "")
        docs.append((i, text, "en", f"s{i % 4}" if i % 11 else None, len(text)))
        labels.append((i, 1, toxic if i % 10 != 3 else docs[-2][0] % 6 == 0))
    return docs + [(900, None, None, "s1", None), (901, "", "en", "s2", 0)], [(a, b, int(c)) for a, b, c in labels]


def test_rows_of_one_id_are_kept_unless_alike(spark, tmp_path):
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice("abcdefgh") * 3 + str(r.randrange(99)) for _ in range(n))
    a, b = prose(60), prose(60)
    rows = [(5, None), (5, a), (5, b), (5, b), (6, a), (7, prose(40)), (None, b), (8, b + " more")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)
    got = P.drop_near_copies(spark, df, str(tmp_path)).collect()
    texts = [x.text for x in got]
    assert len(got) == 5 and texts.count(a) == 1 and [x.doc_id for x in got if x.text is None] == [5]
    assert sum(t in (b, b + " more") for t in texts) == 2 and None in [x.doc_id for x in got if x.text == b]


def test_stages(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "mixing", "bpe"]

    clean = P.drop_toxic(spark, df, str(tmp_path)).cache()
    bad = {"blarg", "zonk", "frib"}
    assert {r.doc_id for r in clean.collect()} == {d for d, t, *_ in docs if not bad & set((t or "").split())}
    assert clean.columns == P.COLUMNS

    single = P.drop_near_copies(spark, clean, str(tmp_path)).cache()
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, _, _, kept in near_brute([(r.doc_id, r.text) for r in clean.collect()]) if kept)

    cut = P.cut_repeats(spark, single, str(tmp_path)).cache()
    want = {d: n - removed for d, n, removed, _, _ in suffix_brute([(r.doc_id, r.text) for r in single.collect()])}
    sources = {r.doc_id: (r.lang, r.source) for r in single.collect()}
    for r in cut.collect():
        assert abs(len(r.text.encode()) - want[r.doc_id]) <= 6 and r.n_chars == len(r.text)
        assert (r.lang, r.source) == sources[r.doc_id]
    assert cut.count() == single.count() and cut.columns == P.COLUMNS

    mixed = P.mix_sources(spark, cut, str(tmp_path)).cache()
    plays = {}
    for r in mixed.collect():
        plays[r.doc_id] = plays.get(r.doc_id, 0) + 1
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert all(texts[r.doc_id] == r.text for r in mixed.collect())
    for r in mixing.mix(cut).collect():
        assert plays.get(r.doc_id, 0) == (1 if r["size"] == 0 else int(r.taken / r["size"] + 0.5)) <= 2
    assert mixed.columns == P.COLUMNS

    tokens = P.encode(spark, mixed, str(tmp_path))
    assert tokens.count() == mixed.count()
    whole = sorted(tuple(r) for r in P.run(spark, str(tmp_path)).collect())
    assert whole == sorted(tuple(r) for r in tokens.collect()) and whole
    assert bpe.bpe_encode(mixed).columns == P.run(spark, str(tmp_path)).columns


def test_stages_begin_with_collected_heaps(spark, tmp_path):
    """Executors collect too (in this session they are the driver): more often than the driver alone does."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    df = spark.createDataFrame([(1, "a b", "en", "s", 3)], SCHEMA)
    for name, stage in P.STAGES[-2:]:
        before = whole()
        stage(spark, df, str(tmp_path))
        assert whole() - before >= 4, name
