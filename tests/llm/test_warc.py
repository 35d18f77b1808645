import pytest

from recordloom.llm import warc as W

PAGES = [
    (3, "http://a/", "<p>one</p>"),
    (1, "http://b/?q=é", "<p>one</p>"),
    (2, "http://c/ x", "two\r\n\r\nWARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"),
    (7, None, None),
    (8, "http://d/", ""),
    (9, "http://e/", "é漢\x00🎉" * 3000),
    (4, "http://f/", "<p>one</p>"),
    (5, "http://g/", "short"),
    (6, "http://h/", "short"),
]


def run(spark, tmp_path, pages, least):
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, digest string, first string")
    W.write_warc(df, str(tmp_path / "w"), least)
    return W.read_warc(spark, str(tmp_path / "w"))


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, tmp_path, least):
    rows = {int(r.capture.split(":")[0]): r for r in W.transactions(run(spark, tmp_path, PAGES, least)).collect()}
    assert len(rows) == len(PAGES)
    firsts = {}
    for page, _, html in sorted(PAGES, key=lambda p: p[0]):
        firsts.setdefault(html or "", page)
    for page, url, html in PAGES:
        r, payload = rows[page], (html or "").encode()
        assert len(r.responses) == len(r.requests) == len(r.metadata) == 1
        own = r.responses[0]
        first = firsts[html or ""] if len(payload) >= least else page
        assert own.type == ("response" if first == page else "revisit")
        assert (own.refers_to or "None").split(":")[0] == str(None if first == page else first)
        assert own.refers_to is None or own.refers_to == rows[first].responses[0].id
        assert own.digest == W.base32_sha1(payload)
        assert r.metadata[0].declared == len(payload)
        if first == page:
            assert bytes(own.payload) == payload and own.payload_bytes == len(payload)
        assert r.requests[0].uri == (("".join(url.split())) if url else "about:blank")


def test_query_columns(spark, tmp_path, monkeypatch):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in W.op4_warc(spark, str(tmp_path)).collect()}
    assert len(got) == len(PAGES)
    assert (got[3].record_type, got[3].refers_to, got[3].payload_bytes) == ("revisit", 1, 10)
    assert (got[8].record_type, got[8].refers_to, got[8].payload_bytes) == ("revisit", 7, 0)
    assert (got[1].record_type, got[1].refers_to) == ("response", None)
    assert got[9].payload_bytes == len(("é漢\x00🎉" * 3000).encode())


def test_empty_and_broken(spark, tmp_path):
    assert run(spark, tmp_path, [], 0).collect() == []
    for bad in (b"HTTP/1.1 200 OK\r\n\r\n", b"WARC/1.1\r\nContent-Length: 5\r\n", b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc"):
        with pytest.raises(ValueError):
            list(W.parse(bad))


def test_large_repeated_and_missing_ids(spark, tmp_path):
    big = 2**53 + 1
    pages = [(big, "u", "same"), (big + 2, "u", "same"), (None, "u", "same"), (None, "v", "other"), (5, "u", "x"), (5, "u", "longer"), (9, "u", "x")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in W.op4_warc(spark, str(tmp_path)).collect()), key=str)
    want = [(big, 4, "response", None), (big + 2, 4, "revisit", big), (None, 4, "response", None), (None, 5, "response", None), (5, 1, "response", None), (5, 6, "response", None), (9, 1, "revisit", 5)]
    assert got == sorted(want, key=str)


def test_reader_passes_batches_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BATCH", 100)
    out = list(W._parsed(True)(iter([__import__("pandas").DataFrame({"content": [b"".join(W._record("response", f"{i}:capture", "u", "t", "h" + W.END + "x" * 60, []).encode() + b"\r\n\r\n" for i in range(9))]})])))
    assert [len(x) for x in out] == [2, 2, 2, 2, 1]
