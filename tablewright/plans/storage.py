"""Source and sink queries: a table is saved to the shared scratch folder and read back."""
from functools import reduce

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.readers import load_table
from ..sources.writers import guess_save_format, save_table, with_extension
from .registry import query, table

_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _round_trip(name: str, suffix: str, kind: str | None = None, **options):
    @query(f"round_trip_{name}", _SQL)
    def _(spark, d):
        path = save_table(table(spark, d, "customer"), scratch_path(spark, name) + suffix, kind)
        return load_table(spark, path, **options)


_round_trip("csv", ".csv")
_round_trip("csv_utf8", ".csv", "csv_utf8")
_round_trip("csv_cp949", ".csv", "csv_cp949")
_round_trip("tsv", ".tsv")
_round_trip("parquet", ".parquet")
_round_trip("json", ".jsonl")


@query("round_trip_probed_format", _SQL)
def _(spark, d):
    """No suffix and no stated format: the first bytes tell."""
    path = scratch_path(spark, "bare")
    table(spark, d, "customer").write.parquet(path)
    return load_table(spark, path)


@query("load_parquet", "SELECT * FROM orders")
def _(spark, d):
    return load_table(spark, f"{d}/orders.parquet")


@query("load_first_rows", "SELECT least(count(*), 300) AS rows FROM orders")
def _(spark, d):
    return load_table(spark, f"{d}/orders.parquet", nrows=300).agg(F.count(F.lit(1)).alias("rows"))


@query("load_psv", "SELECT s_suppkey, s_name FROM supplier")
def _(spark, d):
    path = scratch_path(spark, "psv") + ".psv"
    table(spark, d, "supplier").select("s_suppkey", "s_name").write.option("header", True).option("sep", "|").csv(path)
    return load_table(spark, path)


@query("load_sniffed", "SELECT c_custkey, c_name FROM customer")
def _(spark, d):
    path = scratch_path(spark, "semicolons")
    table(spark, d, "customer").select("c_custkey", "c_name").write.option("header", True).option("sep", ";").csv(path)
    return load_table(spark, path)


@query("load_sniffed_lines", "SELECT c_custkey, c_name || chr(10) || c_mktsegment || ', x' AS note FROM customer")
def _(spark, d):
    """Quoted line ends and commas between semicolons."""
    path = scratch_path(spark, "notes")
    note = F.concat("c_name", F.lit("\n"), "c_mktsegment", F.lit(", x")).alias("note")
    table(spark, d, "customer").select("c_custkey", note).write.option("header", True).option("sep", ";").csv(path)
    return load_table(spark, path)


@query("load_repeated_header", """
    SELECT s_suppkey AS a, s_name AS "a.1", s_nationkey AS a_1, s_acctbal AS "Unnamed: 3" FROM supplier""")
def _(spark, d):
    path = scratch_path(spark, "header") + ".csv"
    line = F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    table(spark, d, "supplier").coalesce(1).select(F.explode(F.array(F.when(F.col("s_suppkey") == 0, "a,a,a_1,"), line)).alias("value")).where(
        "value is not null").write.text(path)
    return load_table(spark, path)


def _documents(customers, body, path: str) -> None:
    """One document for each sixteenth of the customers."""
    part = F.pmod("c_custkey", F.lit(16)).alias("part")
    customers.groupBy(part).agg(body.alias("value")).repartition(16, "part").write.partitionBy("part").text(path)


@query("load_xml", "SELECT c_name AS name, c_custkey AS id FROM customer")
def _(spark, d):
    path = scratch_path(spark, "xml") + ".xml"
    rows = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name")
    rows.write.option("rootTag", "rows").option("rowTag", "row").xml(path)
    return load_table(spark, path).withColumn("id", F.col("id").cast("long"))


@query("load_xml_namespace", "SELECT c_name AS name, c_custkey AS id FROM customer")
def _(spark, d):
    """Rows with a prefix, a document for each sixteenth of the customers."""
    path = scratch_path(spark, "prefixed") + ".xml"
    row = F.format_string("<c:row><c:id>%d</c:id><c:name>%s</c:name></c:row>", "c_custkey", "c_name")
    body = F.concat(F.lit('<c:rows xmlns:c="urn:customers">'), F.array_join(F.collect_list(row), "\n"), F.lit("</c:rows>"))
    _documents(table(spark, d, "customer"), body, path)
    return load_table(spark, path).select("name", F.col("id").cast("long"))


@query("save_by_name", """
    SELECT name, c_custkey, c_name FROM customer, (VALUES ('a.csv'), ('b.jsonl'), ('c.tsv'), ('d.parquet'), ('e.txt')) v(name)""")
def _(spark, d):
    """Saved in the format that the name suggests, under the name that format asks for, and loaded by that name."""
    parts = []
    for name in ("a.csv", "b.jsonl", "c.tsv", "d.parquet", "e.txt"):
        kind = guess_save_format(name)
        path = with_extension(f"{scratch_path(spark, 'named')}/{name}", kind)
        loaded = load_table(spark, save_table(table(spark, d, "customer"), path, kind))
        parts.append(loaded.select(F.lit(name).alias("name"), F.col("c_custkey").cast("long"), "c_name"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("round_trip_csv_documents", "SELECT doc_id, text, lang FROM documents")
def _(spark, d):
    """Texts with line ends, quotes and separators."""
    documents = table(spark, d, "documents").select("doc_id", "text", "lang")
    return load_table(spark, save_table(documents, scratch_path(spark, "documents") + ".csv", "csv_utf8"))


@query("load_json_document", "SELECT c_custkey, c_name FROM customer")
def _(spark, d):
    """Documents over many lines, an array for each sixteenth of the customers."""
    path = scratch_path(spark, "document") + ".json"
    rows = F.to_json(F.collect_list(F.struct("c_custkey", "c_name")))
    spread = F.replace(F.replace(rows, F.lit("},"), F.lit("},\n  ")), F.lit('":'), F.lit('":\n'))
    _documents(table(spark, d, "customer"), spread, path)
    return load_table(spark, path).select("c_custkey", "c_name")


@query("load_cp949_late", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT 0, '서울'")
def _(spark, d):
    """Files that are plain ASCII up to their last row."""
    path = scratch_path(spark, "late") + ".csv"
    names = table(spark, d, "customer").select("c_custkey", "c_name")
    last = spark.range(1).select(F.lit(0).cast("long").alias("c_custkey"), F.lit("서울").alias("c_name"))
    save_table(names.union(last), path, "csv_cp949")
    return load_table(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("load_html", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS \"2\" FROM customer")
def _(spark, d):
    """Pages with tables whose headers are narrower than their rows, a page for each sixteenth of the customers."""
    path = scratch_path(spark, "page") + ".html"
    row = F.format_string("<tr><td>%d<td>%s<td>%d", "c_custkey", "c_name", "c_nationkey")
    body = F.concat(F.lit("<table><tr><th>id<th>name"), F.array_join(F.collect_list(row), ""), F.lit("</table>"))
    _documents(table(spark, d, "customer"), body, path)
    return load_table(spark, path)


@query("load_html_spans", """
    SELECT CAST(c_custkey AS VARCHAR) AS id, CASE k WHEN 0 THEN c_name ELSE c_mktsegment END AS fact FROM customer, (VALUES (0), (1)) v(k)""")
def _(spark, d):
    """A customer's number stands beside two rows."""
    path = scratch_path(spark, "spans") + ".html"
    row = F.format_string("<tr><td rowspan=2>%d<td>%s<tr><td>%s", "c_custkey", "c_name", "c_mktsegment")
    body = F.concat(F.lit("<table><tr><th>id<th>fact"), F.array_join(F.collect_list(row), ""), F.lit("</table>"))
    _documents(table(spark, d, "customer"), body, path)
    return load_table(spark, path)
