import pytest

from recordloom.operators.matcher import Matcher
from recordloom.operators.rules import Comparison as C
from recordloom.operators.rules import Invalid, Rule
from recordloom.streaming.matching import match_stream


def test_stream_gives_the_batch_links(spark, tmp_path):
    kind = "id string, last string, dob string"
    known = spark.createDataFrame([("1", "Smith", "1980"), ("2", "Jones", "1975"), ("3", None, "1980")], kind)
    arriving = [("7", "Smyth", "1980"), ("8", "Jones", "1975"), ("9", "Smith", " ")]
    spark.createDataFrame(arriving, kind).write.parquet(str(tmp_path / "in"))
    rules = [Rule("fuzzy", [C("dob", "exact"), C("last", "jw", "0.85")], "0.8"), Rule("sound", [C("last", "soundex"), C("dob", "exact")], "0.7")]
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    q = match_stream(stream, known, rules, "id").writeStream.format("memory").queryName("links").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.a, r.b, r.rule) for r in spark.sql("SELECT * FROM links").collect()}
    assert got == {("7", "1", 0), ("7", "1", 1), ("8", "2", 0), ("8", "2", 1)}
    batch = Matcher(known.unionByName(spark.createDataFrame(arriving, kind)), rules, "id").run().links.collect()
    assert {(r.b, r.a) for r in batch if r.a < "4" < r.b} == {(a, b) for a, b, _ in got}
    with pytest.raises(Invalid):
        match_stream(stream, known, [Rule("loose", [C("last", "jw", "0.9")])], "id")
