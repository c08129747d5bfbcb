"""Reading of files that many tasks share, against plain readers, with blocks of a few bytes."""
import csv
import io
import json
import random

import pytest

from tablewright.sources import records
from tablewright.sources.readers import header_names, load_table, read_delimited, sniff_delimiter


@pytest.fixture()
def blocks(spark):
    """Files are cut into blocks of 60 bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "60", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def field(rng: random.Random) -> str:
    return rng.choice(["a", "b c", "line\nend", "two\n\nends", 'say "x"', "p,q", "\r\ncr", "", "é", 'x"y', " ", "\n", '"', "long " * 12 + "\n" + "z" * 70])


@pytest.mark.parametrize("seed", range(2))
def test_quoted_line_ends_over_many_tasks(spark, tmp_path, blocks, seed):
    rng = random.Random(seed)
    rows = [[str(i), field(rng), field(rng)] for i in range(60)]
    for part in range(2):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        writer.writerow(["id", "first\nname", "b"])
        writer.writerows(rows[part * 30:][:30])
        (tmp_path / f"part{part}.csv").write_bytes(out.getvalue().encode())
    path = str(tmp_path)
    lines = records.raw_lines(spark, path)
    owners, over = records.open_blocks(lines, ",")
    assert over and len(owners) > 5
    assert records.delimited_records(lines, ",", "utf-8", owners).rdd.getNumPartitions() > 10
    df = read_delimited(spark, path)
    assert df.columns == ["id", "first\nname", "b"] and dict(df.dtypes)["id"] == "int"
    clean = lambda v: v or None
    assert sorted((tuple(r) for r in df.collect()), key=lambda r: r[0]) == [(int(a), clean(b), clean(c)) for a, b, c in rows]


def test_open_quotes():
    for line, sep, want in ((b'a,"b', b",", (True, False)), (b'a,5" x', b",", (False, False)), (b'"a""', b",", (True, False)), (b'","', b",", (False, True)),
                            (b'x";"y', b";", (False, True)), (b'', b",", (False, True)), (b'"a"b,"c"', b",", (False, True))):
        assert (records.open_after(line, False, sep), records.open_after(line, True, sep)) == want, line


def test_stray_quotes_stay_with_their_line(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n5" pipe,1\n6" pipe,2\n')
    assert records.open_blocks(records.raw_lines(spark, str(tmp_path / "q.csv")), ",") == ({}, False)
    assert [tuple(r) for r in load_table(spark, str(tmp_path / "q.csv")).collect()] == [('5" pipe', 1), ('6" pipe', 2)]


@pytest.mark.parametrize("body", ["1,2\n3,4,5\n", '1,"x\ny"\n3,4,5\n'])
def test_records_with_too_many_fields(spark, tmp_path, body):
    (tmp_path / "r.csv").write_text("a,b\n" + body)
    with pytest.raises(Exception, match="more fields than the header"):
        load_table(spark, str(tmp_path / "r.csv")).collect()
    (tmp_path / "s.csv").write_text("a,b,c\n1\n2,x\n,,\n")
    assert [tuple(r) for r in load_table(spark, str(tmp_path / "s.csv")).collect()] == [(1, None, None), (2, "x", None), (None, None, None)]


def test_headers(spark, tmp_path):
    assert header_names(["a", "a", "a_1", ""]) == ["a", "a.1", "a_1", "Unnamed: 3"]
    assert header_names(["a", "a", "a.1", "a"]) == ["a", "a.2", "a.1", "a.3"]
    (tmp_path / "h.csv").write_text("\n a,a,a_1,\n1,2,3,4\n".replace(" a", "a"))
    df = load_table(spark, str(tmp_path / "h.csv"))
    assert df.columns == ["a", "a.1", "a_1", "Unnamed: 3"] and [tuple(r) for r in df.collect()] == [(1, 2, 3, 4)]
    (tmp_path / "only.csv").write_text("x,y\n")
    assert load_table(spark, str(tmp_path / "only.csv")).columns == ["x", "y"]


def test_types_of_records_over_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text('i,l,d,b,t,s,n\n1,5000000000,1.5,true,2020-01-02,"a\nb",\n-2,1,1e3,FALSE,2021-03-04,7,\n')
    df = load_table(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in df.dtypes] == ["int", "bigint", "double", "boolean", "date", "string", "string"]
    stated = read_delimited(spark, str(tmp_path / "t.csv"), schema="i string, l double, d double, b string, t string, s string, n int")
    assert [t for _, t in stated.dtypes] == ["string", "double", "double", "string", "string", "string", "int"] and stated.count() == 2


def test_sniffing_with_line_ends_in_quotes(spark, tmp_path, blocks):
    (tmp_path / "semi").write_text('a;b;c\n1;"x\ny, z";2\n3;"p";4\n' * 10)
    assert sniff_delimiter(spark, str(tmp_path / "semi")) == ";"
    assert load_table(spark, str(tmp_path / "semi")).columns == ["a", "b", "c"]


@pytest.mark.parametrize("seed", range(2))
def test_json_array_over_many_tasks(spark, tmp_path, blocks, seed):
    rng = random.Random(seed)
    value = lambda: rng.choice(['"', "\\", "a]b", "x,{", "é\\\"", "", "n" * 90])
    rows = [{"i": i, "s": value(), "l": [[1, 2], [i]], "o": {"p": value(), "q": [value()]}} for i in range(40)]
    for part in range(2):
        text = json.dumps(rows[part * 20:][:20], indent=rng.choice([1, 3]), ensure_ascii=False)
        (tmp_path / f"d{part}.json").write_text("\n" + text + "\n")
    assert len(records.json_states(records.raw_lines(spark, str(tmp_path)))) > 15
    got = sorted((r.asDict(True) for r in load_table(spark, str(tmp_path), format="json").collect()), key=lambda r: r["i"])
    assert got == rows


@pytest.mark.parametrize("text", ['{"a": 1}\n{bad\n', '[{"a": 1},\n {"a": ]', '[{"a": 1},\n {"a": 2}', '{"a":\n 1', '[{"a":\n1}, x]'])
def test_unreadable_json(spark, tmp_path, text):
    for name in ("x.json", "x.jsonl"):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):
            load_table(spark, str(tmp_path / name)).collect()


@pytest.mark.parametrize("text", [
    '<r xmlns="http://a/b"><row><id>1</id></row><row><id>2</id></row></r>',
    '<p:r xmlns:p="u"><p:row><p:id>1</p:id></p:row><p:row><p:id>2</p:id></p:row></p:r>',
    '<?xml version="1.0" encoding="ISO-8859-1"?>\n<r><row><id>1</id></row><row id="2"/></r>'])
def test_xml_with_namespaces(spark, tmp_path, text):
    (tmp_path / "t.xml").write_text(text)
    assert sorted(r["id"] for r in load_table(spark, str(tmp_path / "t.xml")).collect()) == [1, 2]


def test_xml_encodings(spark, tmp_path):
    for name in ("iso-8859-1", "euc-kr", "utf-8"):
        word = "é" if name.startswith("iso") else "서울"
        (tmp_path / "t.xml").write_bytes(f'<?xml version="1.0" encoding="{name}"?><r><row><c>{word}</c></row><row><c>b</c></row></r>'.encode(name))
        assert sorted(r["c"] for r in load_table(spark, str(tmp_path / "t.xml")).collect()) == sorted([word, "b"]), name
    with pytest.raises(ValueError):
        load_table(spark, str(tmp_path / "t.xml"), row_tag="none")
