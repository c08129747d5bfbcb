import gzip

import pytest

from tablewright.sources.readers import load_table, probe_format, resolve_suffix, sniff_delimiter
from tablewright.sources.writers import guess_save_format, save_table, with_extension

KOREAN = "이름,부서,매출\n김,영업,100\n이,개발,\n"


def test_suffixes():
    assert resolve_suffix("/a/B.CSV.GZ") == ".csv.gz" and resolve_suffix("x.tar.gz") == ".gz" and resolve_suffix("plain") == ""
    assert guess_save_format("a.ndjson") == "json" and guess_save_format("a.xyz") == "csv_utf8_sig"
    assert with_extension("a.txt", "parquet") == "a.parquet" and with_extension("a.CSV", "csv_utf8") == "a.CSV"


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp949", "euc-kr"])
def test_csv_encodings(spark, tmp_path, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes(KOREAN.encode(encoding))
    df = load_table(spark, str(path))
    assert df.columns == ["이름", "부서", "매출"]
    assert [tuple(r) for r in df.collect()] == [("김", "영업", 100), ("이", "개발", None)]


def test_delimited_variants(spark, tmp_path):
    for name, sep in (("t.tsv", "\t"), ("t.psv", "|"), ("t.txt", ",")):
        (tmp_path / name).write_text(sep.join("ab") + "\n" + sep.join("12") + "\n")
        assert [tuple(r) for r in load_table(spark, str(tmp_path / name)).collect()] == [(1, 2)]
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write("a,b\n1,x\n2,y\n")
    assert load_table(spark, str(tmp_path / "t.csv.gz"), nrows=1).count() == 1
    with pytest.raises(ValueError):
        load_table(spark, str(tmp_path / "t.xlsx"))


def test_probing_files_without_suffix(spark, tmp_path):
    (tmp_path / "semi").write_text("a;b\n1;2\n")
    assert sniff_delimiter(spark, str(tmp_path / "semi")) == ";"
    assert load_table(spark, str(tmp_path / "semi")).columns == ["a", "b"]
    (tmp_path / "doc").write_text('[{"a": 1}, {"a": 2}]')
    assert load_table(spark, str(tmp_path / "doc")).count() == 2
    (tmp_path / "page").write_text("<html><table><tr><th>id</th></tr><tr><td>7</td></tr></table></html>")
    assert [tuple(r) for r in load_table(spark, str(tmp_path / "page")).collect()] == [("7",)]
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "pq"))
    part = next((tmp_path / "pq").glob("*.parquet"))
    (tmp_path / "bare").write_bytes(part.read_bytes())
    assert probe_format(spark, str(tmp_path / "bare")) == "parquet"
    assert load_table(spark, str(tmp_path / "bare")).count() == 3


def test_json_forms(spark, tmp_path):
    (tmp_path / "d.json").write_text('[\n {"a": 1, "b": "x"},\n {"a": 2, "b": "y"}\n]')
    assert load_table(spark, str(tmp_path / "d.json")).count() == 2
    (tmp_path / "l.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert load_table(spark, str(tmp_path / "l.json")).count() == 2
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert load_table(spark, str(tmp_path / "l.jsonl")).count() == 3


def test_xml_and_html(spark, tmp_path):
    (tmp_path / "t.xml").write_text("<data><row><id>1</id><n>a</n></row><row><id>2</id><n>b</n></row></data>")
    assert sorted(tuple(r) for r in load_table(spark, str(tmp_path / "t.xml")).select("id", "n").collect()) == [(1, "a"), (2, "b")]
    (tmp_path / "t.html").write_text("<table><tr><td>id</td><td>name</td></tr><tr><td>1</td><td>x</td></tr></table>")
    plain = load_table(spark, str(tmp_path / "t.html"))
    assert plain.columns == ["0", "1"] and plain.count() == 2


@pytest.mark.parametrize("kind", ["csv_utf8_sig", "csv_utf8", "csv_cp949", "tsv", "parquet", "json"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([("김 \"a\", b", 1), (None, 2)], "s string, n long")
    path = save_table(df, str(tmp_path / f"out_{kind}"), kind)
    got = load_table(spark, path, **({"encoding": "cp949"} if kind == "csv_cp949" else {}))
    assert sorted(tuple(r) for r in got.select("s", "n").collect() if r["s"]) == [("김 \"a\", b", 1)] and got.count() == 2
    with pytest.raises(ValueError):
        save_table(df, str(tmp_path / "x"), "xlsx")


def test_line_ends_in_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, "c"), (3, 'say "x", y')], "id long, s string")
    for kind in ("csv_utf8", "tsv"):
        got = load_table(spark, save_table(df, str(tmp_path / f"out_{kind}"), kind))
        assert sorted(tuple(r) for r in got.collect()) == [(1, "a\nb"), (2, "c"), (3, 'say "x", y')]


def test_encoding_of_the_whole_file(spark, tmp_path):
    (tmp_path / "late.csv").write_bytes(b"a,b\n" + b"x,1\n" * 40_000 + "서울,2\n".encode("cp949"))
    assert load_table(spark, str(tmp_path / "late.csv")).where("b = 2").first()["a"] == "서울"
    (tmp_path / "none.csv").write_bytes(b"a,b\n\xff\xff,1\n")
    with pytest.raises(ValueError):
        load_table(spark, str(tmp_path / "none.csv"))


def test_delimiters_in_quotes(spark, tmp_path):
    (tmp_path / "semi").write_text('"Doe, J";1\n"Roe, R";2\n')
    assert sniff_delimiter(spark, str(tmp_path / "semi")) == ";"


def test_json_with_gaps(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n\n{"a": 2}\r\n{"a": 3} \n')
    assert load_table(spark, str(tmp_path / "a.json")).count() == 3
    (tmp_path / "b.json").write_text('{"a":\n 1, "b": [1,\n2]}\n')
    assert load_table(spark, str(tmp_path / "b.json")).count() == 1
    (tmp_path / "c.json").write_text('{"a":\n 1}\n{"a":\n 2}\n')
    with pytest.raises(ValueError):
        load_table(spark, str(tmp_path / "c.json"))


def test_xml_of_mixed_rows_and_wide_html(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<d><!-- <x> --><a><i>1</i></a><b><i>2</i><j>3</j></b><a><i>4</i></a></d>")
    df = load_table(spark, str(tmp_path / "m.xml"))
    assert sorted(df.columns) == ["i", "j"] and sorted(r["i"] for r in df.collect()) == [1, 2, 4]
    (tmp_path / "w.html").write_text("<table><tr><th>a</tr><tr><td>1<td>2</tr></table>")
    assert [r.asDict() for r in load_table(spark, str(tmp_path / "w.html")).collect()] == [{"a": "1", "1": "2"}]
