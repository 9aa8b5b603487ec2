import pytest
from pyspark.sql import functions as F

from tomewright.functions import numbers, text, tokens


@pytest.mark.parametrize(
    "number, prefix, match",
    [("702.9", "702.9", True), ("702.9b", "702.9", True), ("702.90", "702.9", False), ("702.90a", "702.9", False), ("702.1", "702", True), ("702.1", "70", False), ("702.9b", "702.9b", True), ("702.9b", "702.9a", False)],
)
def test_prefix(spark, number, prefix, match):
    df = spark.createDataFrame([(number, prefix)], "n string, p string")
    assert df.select(numbers.matches_prefix(F.col("n"), F.col("p"))).first()[0] is match


def test_numeric_order_and_parent(spark):
    df = spark.createDataFrame([("702.10",), ("702.2a",), ("702.1",), ("x",), ("702.2",), ("704",)], "n string")
    assert [r[0] for r in df.orderBy(numbers.sort_key(F.col("n"))).collect()] == ["702.1", "702.2", "702.2a", "702.10", "704", "x"]
    got = spark.createDataFrame([("702.9b",), ("702.9",), ("704",)], "n string").select(numbers.parent_of(F.col("n"))).collect()
    assert [r[0] for r in got] == ["702.9", "702.9", "704"]


def test_number_query(spark):
    df = spark.createDataFrame([("７０２．９ｂ",), (" 702. ",), ("702.9b flying",), ("",)], "t string")
    assert [r[0] for r in df.select(numbers.number_query(tokens.normalized(F.col("t")))).collect()] == ["702.9b", "702", None, None]


def test_tokens(spark):
    df = spark.createDataFrame([("Flying 702.9b works",), ("飛行を持つ",), ("player's 火",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(tokens.tokens(F.col("t"))).collect()]
    assert got == [["flying", "702.9b", "works"], ["飛行", "行を", "を持", "持つ"], ["player's", "火"], [], []]


def test_dates_numbers_looks(spark):
    df = spark.createDataFrame([("２０２５-02-7",), ("CR 20250919 en",), ("2024年6月14日",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(text.iso_date(F.col("t"))).collect()] == ["2025-02-07", "2025-09-19", "2024-06-14", None, None]
    df = spark.createDataFrame([("ルール７０２．９Ｂ.",), (" 702.1 ",), ("",), (None,), ("702.​3",), ("odd",)], "t string")
    assert [r[0] for r in df.select(text.rule_number(F.col("t"))).collect()] == ["702.9b", "702.1", None, None, "702.3", "odd"]
    assert text.same_look("ｶﾞ a​ b　c") == text.same_look("ガa bc") == "ガabc"
    assert text.same_look(None) is None and text.same_look("é") == text.same_look("é")
    df = spark.createDataFrame([("See rules 702.9b and 12.3, 702.9b; rule 100.1.",)], "t string")
    assert df.select(text.rule_mentions(F.col("t"))).first()[0] == ["702.9b", "100.1"]


def test_nfkc(spark):
    df = spark.createDataFrame([("７０２．９Ｂ",), (None,)], "t string")
    assert [r[0] for r in df.select(text.nfkc_lower("t")).collect()] == ["702.9b", None]
