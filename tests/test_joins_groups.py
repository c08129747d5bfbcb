import pytest
from pyspark.sql import functions as F

from tablewright.operators import grouping as G, joins as J


def sets(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)


def test_join_columns_and_null_keys(spark):
    l = spark.createDataFrame([(1, "a", 1), (None, "b", 2), (3, "c", 3)], "k long, v string, x long")
    r = spark.createDataFrame([(1, "p", 7), (None, "q", 8), (4, "r", 9)], "k long, v string, y long")
    inner = J.join_tables(l, r, "k", "k")
    assert inner.columns == ["k", "v_left", "x", "v_right", "y"]
    assert sets(inner, "k", "v_left", "v_right") == [(1, "a", "p"), (None, "b", "q")]
    assert sets(J.join_tables(l, r, "k", "k", "outer"), "k", "x", "y") == sorted([(1, 1, 7), (None, 2, 8), (3, 3, None), (4, None, 9)], key=repr)
    assert sets(J.join_tables(l, r, "k", "k", "right"), "k") == sorted([(1,), (None,), (4,)], key=repr)
    other = J.join_tables(l, r.withColumnRenamed("k", "id"), ["k"], ["id"], "left")
    assert other.columns == ["k", "v_left", "x", "id", "v_right", "y"]
    with pytest.raises(ValueError):
        J.join_tables(l, r, "k", "k", "cross")


def test_lookup_fixtures(spark):
    l = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    r = spark.createDataFrame([(1, 90), (2, 80)], "id long, score long")
    assert sets(J.lookup_column(l, r, "id", "id", "score", "id"), "id", "score") == [(1, 90), (2, 80)]
    goods = spark.createDataFrame([("사과", 1000), ("배", 2000)], "`상품명` string, `가격` long")
    stock = spark.createDataFrame([("사과", 10), ("배", 20)], "`상품명` string, `재고` long")
    assert sets(J.lookup_column(goods, stock, "상품명", "상품명", "재고", "재고"), "가격", "재고") == [(1000, 10), (2000, 20)]


def test_lookup_normalises_keys_and_takes_the_first(spark):
    l = spark.createDataFrame([("13",), (" 13 ",), ("99",), (None,), (" ",)], "k string")
    r = spark.createDataFrame([(0, 13.0, "first"), (1, 13.0, "second"), (2, None, "none")], "n long, code double, v string")
    got = J.lookup_column(l, r, "k", "code", "v", "n")
    assert sets(got, "v") == sorted([("first",), ("first",), (None,), (None,), (None,)], key=repr)
    stats = J.lookup_stats(l, r, "k", "code").first()
    assert (stats["total"], stats["matched"], stats["unmatched"]) == (5, 2, 3)
    assert J.lookup_column(l, r, "k", "code", "v", "n", "k").columns == ["k"]
    with pytest.raises(ValueError):
        J.lookup_column(l, r, "gone", "code", "v", "n")


def test_enrich_fixtures(spark):
    base = spark.createDataFrame([(13, "a"), (99, "b"), (7, "c")], "idx long, name string")
    extra = spark.createDataFrame([(0, "13", "u1", "i1", ""), (1, "7", "u2", "i2", "")], "n long, code string, url string, img string, error string")
    got = J.enrich(base, extra, "idx", "code", "n")
    assert "code" not in got.columns and sets(got, "idx", "img") == sorted([(13, "i1"), (99, None), (7, "i2")], key=repr)
    clash = J.enrich(spark.createDataFrame([("x", "old")], "code string, url string"),
                     spark.createDataFrame([(0, "x", "new", "i"), (1, "x", "newer", "j")], "n long, code string, url string, img string"), "code", "code", "n")
    assert sets(clash, "url", "url_crawl", "img") == [("old", "new", "i")]
    nulls = J.enrich(spark.createDataFrame([(1,), (None,)], "id long"),
                     spark.createDataFrame([(None, "bad"), ("1", "ok")], "code string, v string"), "id", "code", "v")
    assert sets(nulls, "id", "v") == sorted([(1, "ok"), (None, None)], key=repr)
    with pytest.raises(ValueError):
        J.enrich(base.limit(0), extra, "idx", "code", "n")


def test_stack(spark):
    a, b = spark.createDataFrame([(1, "x")], "id long, s string"), spark.createDataFrame([(2, 5)], "id long, n long")
    out = J.stack_tables([a, b], order_by="id", number="row")
    assert sets(out, "id", "s", "n", "row") == [(1, "x", None, 1), (2, None, 5, 2)]
    with pytest.raises(ValueError):
        J.stack_tables([])


def test_group_summary(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, None)], "g string, v long")
    assert [tuple(r) for r in G.group_summary(df, ["g"], "v", "sum").collect()] == [("x", 3), ("y", 3), (None, 0)]
    assert [tuple(r) for r in G.group_summary(df, "g", "v", "count").collect()] == [("x", 2), ("y", 1), (None, 0)]
    assert [tuple(r) for r in G.group_summary(df, "g", "v", "median").collect()] == [("x", 1.5), ("y", 3.0), (None, None)]
    assert [tuple(r) for r in G.group_summary(df, "g", "v", "nunique").collect()] == [("x", 2), ("y", 1), (None, 0)]
    with pytest.raises(ValueError):
        G.group_summary(df, "g", "v", "skewness")


def test_frequencies(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (" ",), (None,)], "s string")
    assert [tuple(r) for r in G.top_values(df, "s", 2).collect()] == [("a", 2, 50.0), ("b", 1, 25.0)]
    other = dict(tuple(r) for r in G.top_values_with_other(df, "s", 1).collect())
    assert other == {"a": 2, "기타": 4}
    assert G.top_values_with_other(df, "s", 50).where("value = '기타'").count() == 0


def test_describe_groups_with_one_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0), (None, 1.0)], "g string, v double")
    got = {r["group"]: (r["count"], r["mean"], r["std"], r["median"]) for r in G.describe_groups(df, "g", "v").collect()}
    assert got["a"] == (1, 1.0, None, 1.0) and got["b"][3] == 3.0 and "None" in got


def test_mixed_types(spark):
    a, b = spark.createDataFrame([(1,)], "k long"), spark.createDataFrame([("x",)], "k string")
    assert sets(J.stack_tables([a, b]), "k") == [("1",), ("x",)]
    with pytest.raises(ValueError):
        J.join_tables(a, b, "k", "k")
    flags = spark.createDataFrame([("a", True), ("a", None), ("a", True)], "g string, v boolean")
    assert G.group_summary(flags, "g", "v", "sum").first()["v"] == 2
    numbers = spark.createDataFrame([("a", 2.0), ("a", 3.0), ("b", None)], "g string, v double")
    assert [r["v"] for r in G.group_summary(numbers, "g", "v", "prod").collect()] == [6.0, 1.0]
