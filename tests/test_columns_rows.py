import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewright.functions.missing import is_missing
from tablewright.functions.naming import dedupe_names, resolve_columns, unique_name
from tablewright.functions.values import lookup_key
from tablewright.operators import columns as C, rows as R


def rows(df, *names):
    return [tuple(r[n] for n in names or df.columns) for r in df.collect()]


@pytest.fixture(scope="module")
def cities(spark):
    return spark.createDataFrame(
        [(0, "kim", "서울", 1), (1, "lee", "부산", 2), (2, "Park", "서울시", 3), (3, None, None, 4)],
        "id long, name string, city string, n long")


def test_names():
    assert unique_name(["a", "a_1"], "a") == "a_2" and unique_name(["b"], "a") == "a"
    assert dedupe_names([0, "x", "x", 0]) == ["0", "x", "x_1", "0_1"]


def test_resolve_keeps_request_order(cities):
    assert resolve_columns(cities, ["n", "gone", "id", "n"]) == ["n", "id"]


def test_integer_names_resolve_and_move(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "`0` long, `1` long")
    assert C.move_column(df, "1", "0").columns == ["1", "0"]
    assert C.move_column(df, "9", "0").columns == ["0", "1"]


def test_missing_counts_blank_unicode_space_and_nan(spark):
    df = spark.createDataFrame([("a",), ("",), (" \t\n",), ("　",), ("\x1c",), (None,), (" b ",)], "s string")
    assert [r[0] for r in df.select(is_missing(df, "s")).collect()] == [False, True, True, True, True, True, False]
    num = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in num.select(is_missing(num, "v")).collect()] == [False, True, True]


def test_convert(spark):
    df = spark.createDataFrame([("2.5",), ("3.5",), (" 7 ",), ("x",), (None,), ("9007199254740993",)], "s string")
    assert rows(C.convert_type(df, "s", "int64")) == [(2,), (4,), (7,), (None,), (None,), (9007199254740993,)]
    words = spark.createDataFrame([(" Yes",), ("t",), ("0",), ("N",), ("maybe",), (None,)], "s string")
    assert rows(C.convert_type(words, "s", "bool")) == [(True,), (True,), (False,), (False,), (None,), (None,)]
    days = spark.createDataFrame([("2024-02-30",), ("2024-02-29",)], "s string")
    assert rows(C.convert_type(days, "s", "datetime")) == [(None,), (dt.datetime(2024, 2, 29),)]
    floats = spark.createDataFrame([(float("nan"),), (0.5,), (1.5,), (1e30,)], "v double")
    assert rows(C.convert_type(floats, "v", "int")) == [(None,), (0,), (2,), (None,)]
    with pytest.raises(ValueError):
        C.convert_type(df, "s", "category")


def test_rename_add_insert_duplicate(cities):
    with pytest.raises(ValueError):
        C.rename_column(cities, "name", "city")
    with pytest.raises(ValueError):
        C.rename_column(cities, "gone", "x")
    assert C.rename_column(cities, "name", "name").columns == cities.columns
    with pytest.raises(ValueError):
        C.add_column(cities, "city")
    assert C.insert_column(cities, "name").columns == ["id", "name", "새열", "city", "n"]
    assert C.insert_column(cities, "name", "left", "x", 1).columns == ["id", "x", "name", "city", "n"]
    twice = C.duplicate_column(C.duplicate_column(cities, "n"), "n")
    assert twice.columns[-2:] == ["n_copy", "n_copy_1"]
    assert C.delete_columns(cities, ["n", "gone"]).columns == ["id", "name", "city"]


def test_merge_columns(spark):
    df = spark.createDataFrame([("서울", "강남"), ("부산", "해운대"), (None, "x"), ("  ", "y")], "A string, B string")
    out = C.merge_columns(df, ["B", "A"], "주소", separator=" ")
    assert out.columns == ["주소"]
    assert rows(out) == [("서울 강남",), ("부산 해운대",), (" x",), (" y",)]
    with pytest.raises(ValueError):
        C.merge_columns(df, ["A"], "x")
    with pytest.raises(ValueError):
        C.merge_columns(df, ["A", "B"], "A")


def test_split_column(spark):
    df = spark.createDataFrame([("서울-강남",), ("부산-해운대",), (None,), ("a--b",)], "addr string")
    out = C.split_column(df, "addr", "-", prefix="주소")
    assert out.columns == ["주소_1", "주소_2", "주소_3", "addr"]
    assert rows(out, "주소_1", "주소_2", "주소_3") == [
        ("서울", "강남", None), ("부산", "해운대", None), (None, None, None), ("a", None, "b")]
    dots = spark.createDataFrame([("1.2",)], "v string")
    assert rows(C.split_column(dots, "v", ".", drop_source=True)) == [("1", "2")]
    empty = spark.createDataFrame([(None,)], "v string")
    assert C.split_column(empty, "v", ",").columns == ["v_1", "v"]
    assert C.read_separator(r"\t") == "\t"


def test_split_then_merge_is_identity(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    parts = C.split_column(p, "p_name", " ", prefix="w", drop_source=True)
    again = C.merge_columns(parts, ["w_1", "w_2"], "p_name", separator=" ")
    assert p.exceptAll(again.select("p_partkey", "p_name")).count() == 0


def test_fill_sequence_and_clear(cities):
    out = C.fill_sequence(cities, "n", "id", start=10, step=-2)
    assert sorted(rows(out, "id", "n")) == [(0, 10), (1, 8), (2, 6), (3, 4)]
    by_itself = C.fill_sequence(cities, "id", "id", start=5)
    assert sorted(rows(by_itself, "id", "n")) == [(5, 1), (6, 2), (7, 3), (8, 4)]
    cleared = C.clear_columns(cities, ["n", "gone"])
    assert cleared.dtypes == cities.dtypes and {r["n"] for r in cleared.collect()} == {None}


def test_search(cities):
    assert R.search(cities, "서울").count() == 2
    assert R.search(cities, "").count() == 4
    assert rows(R.search(cities, "PARK", "name"), "id") == [(2,)]
    assert rows(R.search(cities, "kim", "name", exclude=True), "id") == [(1,), (2,), (3,)]
    # An exact test is unknown for NULL: the row is in neither answer.
    assert rows(R.search(cities, "kim", "name", exact=True), "id") == [(0,)]
    assert rows(R.search(cities, "kim", "name", exact=True, exclude=True), "id") == [(1,), (2,)]
    assert rows(R.search(cities, " ", "city"), "id") == [(3,)]
    assert rows(R.search(cities, " ", "city", exclude=True), "id") == [(0,), (1,), (2,)]


def test_extract_and_delete_cover_the_table(cities):
    assert rows(R.extract_rows(cities, [2, 0, 2, 77], "id"), "id") == [(2,), (0,)]
    assert rows(R.extract_rows(cities, ["2", "0"], "id"), "city") == [("서울시",), ("서울",)]
    none = R.extract_rows(cities, [], "id")
    assert none.count() == 0 and none.schema == cities.schema
    kept = R.delete_rows(cities, [2, 0], "id").unionByName(R.extract_rows(cities, [2, 0], "id"))
    assert sorted(rows(kept, "id")) == [(0,), (1,), (2,), (3,)]
    cleared = {r["id"]: r["city"] for r in R.clear_rows(cities, [0], "id").collect()}
    assert cleared == {0: None, 1: "부산", 2: "서울시", 3: None}


def test_blank_rows(cities):
    above = R.insert_blank_rows(cities, 1, "id", "id", side="above", count=2).orderBy("row_no")
    assert rows(above, "id", "row_no") == [(0, 1), (None, 2), (None, 3), (1, 4), (2, 5), (3, 6)]
    below = R.insert_blank_rows(cities, 3, "id", "id").orderBy("row_no")
    assert rows(below, "id")[-1] == (None,)
    assert R.insert_blank_rows(cities, 99, "id", "id").count() == 4
    assert rows(R.append_blank_rows(cities, "id", count=2).orderBy("row_no"), "id", "row_no")[-2:] == [(None, 5), (None, 6)]


def test_cell_updates(spark, cities):
    edits = R.cell_updates(spark, [(0, "n", "5.9"), (1, "n", "x"), (2, "n", " "), (0, "city", " a "), (9, "n", "1"), (0, "gone", "1")])
    out = {r["id"]: (r["city"], r["n"]) for r in R.apply_updates(cities, edits, "id").collect()}
    assert out == {0: ("a", 5), 1: ("부산", None), 2: ("서울시", None), 3: (None, 4)}
    assert rows(R.unreadable_updates(cities, edits, "id"), "row_id", "value") == [(1, "x")]
    assert rows(R.clear_cells(cities, [(0, "city")], "id").where("id = 0"), "city") == [(None,)]


def test_find_replace(spark):
    df = spark.createDataFrame([(1, "aXa.a", 10), (2, None, 21), (3, "b", 3)], "id long, s string, n long")
    assert rows(R.find_replace(df, "A", "$1", columns="s"), "s") == [("$1X$1.$1",), (None,), ("b",)]
    assert rows(R.find_replace(df, "A", "c", columns="s", match_case=True), "s") == [("aXa.a",), (None,), ("b",)]
    assert rows(R.find_replace(df, ".", "-", columns="s"), "s") == [("aXa-a",), (None,), ("b",)]
    assert rows(R.find_replace(df, "1", "one", columns=["n"]), "n") == [("one",), ("one",), ("3",)]
    scoped = R.find_replace(df, "a", "z", columns="s", ids=[3, 2], row_id="id")
    assert sorted(rows(scoped, "id", "s")) == [(1, "aXa.a"), (2, None), (3, "b")]
    with pytest.raises(ValueError):
        R.find_replace(df, "", "x")


def test_lookup_key(spark):
    df = spark.createDataFrame([(13.0, " 13 ", True), (13.5, "13.0", False), (None, "  ", None)], "d double, s string, b boolean")
    out = df.select(*[lookup_key(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns])
    assert rows(out) == [("13", "13", "True"), ("13.5", "13.0", "False"), (None, None, None)]


def test_drop_missing_and_user_function(spark):
    df = spark.createDataFrame([("a", 1.0), (" ", 2.0), ("c", float("nan"))], "s string, v double")
    assert rows(R.drop_missing_rows(df)) == [("a", 1.0)]
    assert R.drop_missing_rows(df, ["s"]).count() == 2
    assert R.apply_function(df, lambda t: t.limit(1)).count() == 1
    with pytest.raises(TypeError):
        R.apply_function(df, lambda t: 3)


def test_row_local_operators_run_on_a_stream(spark, sf_dir, tmp_path):
    stored = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    stored.write.parquet(str(tmp_path / "supplier"))
    source = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "supplier"))
    out = C.merge_columns(R.search(source, "supplier", "s_name"), ["s_suppkey", "s_name"], "label", separator=":")
    query = out.writeStream.format("memory").queryName("labels_out").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("labels_out").count() == stored.count()


def test_booleans_as_text_and_untouched_types(spark):
    df = spark.createDataFrame([(1, True, "x")], "id long, b boolean, s string")
    assert rows(C.convert_type(df, "b", "object"), "b") == [("True",)]
    assert rows(C.merge_columns(df, ["id", "b"], "m"), "m") == [("1True",)]
    out = R.find_replace(df, "x", "y")
    assert out.dtypes == df.dtypes and rows(out) == [(1, True, "y")]
    assert dict(R.find_replace(df, "ru", "no").dtypes) == {"id": "bigint", "b": "string", "s": "string"}
