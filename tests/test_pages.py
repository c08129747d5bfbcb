import tracemalloc

import pytest

from tablewright.pages import elements as E, extract as X, structure as S
from tablewright.pages.css import compile_selector

HTML = """<html><head><title>t</title><script>var a = "<p>";</script></head><body>
<h2><a href="/x">Head &amp; tail</a></h2>
<div id="box"><ul class="items big"><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a><li><a href="/c"> Gamma </a></ul></div>
<span class="price">100</span><img src="/a.png"><img src="/b.png" data-k="v w"><p>one<p>two <b>bold</b>
<div class="x.y"></div></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "u1", HTML), (2, "u2", None), (3, "u3", "<li>only")], "page_id long, url string, html string")


def values(pages, selector, **options):
    out = X.extract_values(pages.where("page_id = 1"), selector, **options).orderBy("pos")
    return [r["value"] for r in out.collect()]


@pytest.mark.parametrize("selector, attr, want", [
    ("ul.items li a", "text", ["Alpha", "Beta", "Gamma"]),
    ("ul.items > li > a", "href", ["/a", "/b", "/c"]),
    ("body > a", "text", []),
    ("#box .big li:nth-child(2)", "text", ["Beta"]),
    ("li:first-child a, .price", "text", ["Alpha", "100"]),
    ("img[src]", "src", ["/a.png", "/b.png"]),
    ("img[src$='b.png']", "src", ["/b.png"]),
    ("img[data-k~=w]", "src", ["/b.png"]),
    ("img[data-k^=v][src*='/b']", "src", ["/b.png"]),
    ("img[data-k=v]", "src", []),
    ("h2 *", "text", ["Head & tail"]),
    ("p", "text", ["one", "two bold"]),
    ("ul.item", "text", []),
    ("h2 a", "src", [""]),
])
def test_selectors(pages, selector, attr, want):
    assert values(pages, selector, attr=attr) == want


def test_limit_and_errors(pages):
    assert values(pages, "li a", limit=2) == ["Alpha", "Beta"]
    assert values(pages, "li a", limit=0) == []
    for bad in ("", "  ", "a >", "> a", "a:hover", "a[", "a,,b"):
        with pytest.raises(ValueError):
            compile_selector(bad)
    with pytest.raises(ValueError):
        X.extract_values(pages, "a", attr="title")


def test_fields(pages):
    fields = X.parse_fields("# comment\n title | h2 a \nlink|h2 a|HREF\nimg|img|src\nnone|.gone\n")
    row = X.extract_fields(pages, fields).where("page_id = 1").first()
    assert (row["title"], row["link"], row["img"], row["none"]) == ("Head & tail", "/x", "/a.png | /b.png", "")
    first = X.extract_fields(pages, fields, join_multi=False).where("page_id = 1").first()
    assert first["img"] == "/a.png"
    assert X.extract_fields(pages, fields).where("page_id = 2").first()["title"] == ""
    for bad in ("", "only", "a|b|title", "|b"):
        with pytest.raises(ValueError):
            X.parse_fields(bad)


def test_batch(spark, pages):
    codes = spark.createDataFrame([("1",), ("2",), ("9",)], "code string")
    out = X.extract_batch(codes, pages, "u{code}", [X.Field("price", ".price")], page_order="page_id")
    got = {r["code"]: (r["url"], r["price"], r["error"]) for r in out.collect()}
    assert got["1"] == ("u1", "100", "") and got["2"] == ("u2", "", "") and got["9"][2] != ""
    with pytest.raises(ValueError):
        X.extract_batch(codes, pages, "u{key}", [X.Field("price", ".price")], page_order="page_id")


def test_params(spark):
    df = spark.createDataFrame([(0, " b \n# no\n\na"), (1, "a\r\nc")], "id long, text string")
    got = X.params_from_lines(df, "text", "id").orderBy("k0", "k1").collect()
    assert [r["param"] for r in got] == ["b", "a", "c"]
    col = spark.createDataFrame([(0, " x "), (1, None), (2, "x"), (3, " ")], "id long, v string")
    assert [r["param"] for r in X.params_from_column(col, "v", "id").collect()] == ["x"]


def test_structure_scan(pages):
    found = {r["selector"]: r for r in S.scan_structure(pages).collect()}
    best = found["ul.items.big > li"]
    assert best["count"] == 3 and best["suggested_attr"] == "href" and best["samples"] == ["Alpha", "Beta", "Gamma"]
    # 3 of 40 items, all with text and link, a list tag without a class of its own
    assert abs(best["score"] - (3 / 40 * 45 + 30 + 15 + 8)) < 0.01


def test_structure_limits(spark):
    items = lambda n, cls="": "".join(f"<p{cls}>t{i}</p>" for i in range(n))
    html = f"<body><div>{items(2)}</div><section>{items(4, ' class=k')}</section>{'<div><i></i></div>' * 3}</body>"
    got = S.scan_structure(spark.createDataFrame([(html,)], "html string")).collect()
    assert [(r["selector"], r["count"]) for r in got] == [("section > p.k", 4)]


def test_tables(spark):
    html = "<table><thead><tr><th>id</th><th>name</th></tr></thead><tbody><tr><td>1<td>x<tr><td>2</td><td><b>y</b> z</td></tr></table><table><tr><td>no</table>"
    got = E.page_tables(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("row_no", "col_no").collect()
    assert [(r["row_no"], r["col_no"], r["is_header"], r["text"]) for r in got] == [
        (0, 0, True, "id"), (0, 1, True, "name"), (1, 0, False, "1"), (1, 1, False, "x"), (2, 0, False, "2"), (2, 1, False, "y z")]


def test_long_tables_are_not_held(spark):
    """A page's cells are given out while it is read, whatever its length; also in several batches."""
    n = 60_000
    html = "<table><tr><th>id<th>name" + "".join(f"<tr><td rowspan=2>{i}<td>name {i}<tr><td>other {i}" for i in range(n)) + "</table>"
    tracemalloc.start()
    try:
        cells = sum(1 for _ in E.table_grid(html))
        assert cells == 2 + 4 * n and tracemalloc.get_traced_memory()[1] < 6 * len(html)
    finally:
        tracemalloc.stop()
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>none"), (4, "<table><td>x"), (5, html)], "page_id long, html string")
    got = E.page_tables(pages)
    assert got.groupBy("page_id").count().orderBy("page_id").collect() == [(1, cells), (4, 1), (5, cells)]
    assert [tuple(r) for r in got.where(f"page_id = 5 and row_no > {2 * n - 2}").orderBy("row_no", "col_no").collect()] == [
        (5, 2 * n - 1, 0, False, f"{n - 1}"), (5, 2 * n - 1, 1, False, f"name {n - 1}"),
        (5, 2 * n, 0, False, f"{n - 1}"), (5, 2 * n, 1, False, f"other {n - 1}")]


def test_rows_that_stay_open(monkeypatch):
    """What is let go on the way changes nothing: cells left open, tables in cells, text beside the table."""
    html = ("x<table><tr><td>a<div><tr><td>b</div>c<!-- <td> --><td rowspan=3>d<table><tr><td>e</table>f"
            "<tr><th colspan=2>g &amp; h<td title =\"i > j<k>\">l<script>m<td></script><tr><td>n</table>o<table><td>p")
    whole = [list(E.table_grid(html, number)) for number in range(4)]
    assert whole == [
        [(0, 0, False, "a"), (1, 0, False, "b c"), (1, 1, False, "d e f"), (2, 0, True, "g & h"), (2, 1, False, "d e f"), (2, 2, True, "g & h"), (2, 3, False, "l"), (3, 0, False, "n"), (3, 1, False, "d e f")],
        [(0, 0, False, "e")],
        [(0, 0, False, "p")],
        []]
    for held in range(12):
        monkeypatch.setattr(E, "_HELD", held)
        assert [list(E.table_grid(html, number)) for number in range(4)] == whole
