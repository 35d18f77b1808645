import duckdb
import pandas as pd
import pytest

from recordloom.llm import mixing as M


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def oracle(pdf):
    con = duckdb.connect()
    con.register("documents", pdf)
    return con.execute(M.ORACLE).fetchall()


def shared_out(sizes):
    """Targets by the words of the contract: share by weight, cap, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {s: 0.0 for s in names}, set(names), 1.5 * sum(sizes.values())
    while left > 1e-9 and free:
        whole = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / whole
        left = 0.0
        for s in list(free):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                free.discard(s)
    return target


def table(n, sources):
    rows = [(i * 7 % (n * 8), " ".join("w" * (i * j % 5 + 1) for j in range(i * 31 % 90)), sources[i * i % len(sources)]) for i in range(n)]
    return rows + [(10**6, None, "a"), (10**6 + 1, "", None), (10**6 + 2, "\x0b\x0c \t", "b"), (10**6 + 3, "x" * 10000, "z"), (None, "one two", "a"), (rows[0])]


@pytest.mark.parametrize("sources", [["a", "b", "c", None], ["only"], ["a"] * 9 + ["b", "ä", "Z"], [f"src{i}" for i in range(20)], ["big"] * 40 + [f"t{i}" for i in range(9)]])
def test_against_sql_and_promises(spark, sources):
    rows = table(300, sources)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    mixed = M.mix(df, slices=5, ranges=3)
    got = mixed.toPandas()
    pdf = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    want = sorted((tuple(r) for r in oracle(pdf)), key=str)
    assert rows_of(mixed.select("doc_id", "size", "source_size", "target", "taken")) == want
    assert (got.taken <= 2 * got["size"]).all() and (got.target >= 0).all()
    sizes = {None if pd.isna(k) else k: int(v) for k, v in got.groupby("source", dropna=False)["size"].sum().items()}
    wanted = shared_out(sizes)
    for k, v in got.groupby("source", dropna=False).target.first().items():
        assert abs(v - wanted[None if pd.isna(k) else k]) < 1e-6 * max(1, v)
    for _, g in got.groupby("source", dropna=False):
        # what a source lacks or has too much is a piece, or that and its share of what others lack
        target = g.target.iloc[0]
        assert abs(g.taken.sum() - target) <= max(1, min(M.PIECE, target / M.PIECES)) * len(sizes) + 1
        assert target <= 2 * g["size"].sum() + 1e-9
    total = int(got["size"].sum())
    assert abs(got.groupby("source", dropna=False).target.first().sum() - 1.5 * total) < 1e-6 * total
    assert got.taken.sum() == int(1.5 * total + 0.5)


def test_queue_is_cut_in_order_of_finish_times(spark, monkeypatch):
    monkeypatch.setattr(M, "PIECE", 7)
    df = spark.createDataFrame(table(200, ["a", "b", "c", None]), "doc_id long, text string, source string")
    own = M.placed(df)
    budget = int(1.5 * own.agg({"size": "sum"}).first()[0] + 0.5)
    rows = M.truncated(M.queue(own), budget, 6).toPandas()
    assert rows["range"].nunique() == 6
    rows = rows.sort_values(["finish", "range"], kind="stable")
    assert rows["range"].is_monotonic_increasing
    whole, cut = rows[rows.served == rows.words], rows[(rows.served > 0) & (rows.served < rows.words)]
    assert len(cut) <= 1 and rows.served.sum() == budget
    assert whole.finish.max() <= rows[rows.served == 0].finish.min() and abs(whole.finish.max() - 1) < 0.05


def test_empty_table(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    nothing = M.mix(spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r.taken) for r in nothing] == [(0, 0), (0, 0)]
