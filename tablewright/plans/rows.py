"""Filter, row and cell queries."""
from pyspark.sql import functions as F

from ..functions.values import lookup_key
from ..operators import rows as R
from .registry import GAPPY_SQL, gappy_orders, query, table

_LISTED = [7, 3, 120, 42, 3, 99999999]


@query("search_one_column", "SELECT * FROM part WHERE contains(lower(p_name), 'bolt')")
def _(spark, d):
    return R.search(table(spark, d, "part"), " BOLT ", "p_name")


@query("search_all_columns", """
    SELECT * FROM customer WHERE contains(CAST(c_custkey AS VARCHAR), '99') OR contains(lower(c_name), '99')
        OR contains(CAST(c_nationkey AS VARCHAR), '99') OR contains(CAST(c_acctbal AS VARCHAR), '99')
        OR contains(lower(c_mktsegment), '99')""")
def _(spark, d):
    return R.search(table(spark, d, "customer"), "99")


@query("search_exclude", f"SELECT * FROM {GAPPY_SQL} g WHERE NOT contains(lower(o_orderpriority), 'urgent')")
def _(spark, d):
    return R.search(gappy_orders(spark, d), "Urgent", "o_orderpriority", exclude=True)


@query("search_exact", "SELECT * FROM customer WHERE lower(c_mktsegment) = 'building'")
def _(spark, d):
    return R.search(table(spark, d, "customer"), "Building", "c_mktsegment", exact=True)


@query("search_exact_exclude", """
    SELECT o_orderkey, p FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders) o
    WHERE lower(p) <> '1-urgent'""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return R.search(o, "1-URGENT", "p", exact=True, exclude=True)


@query("search_missing", f"SELECT * FROM {GAPPY_SQL} g WHERE o_orderpriority IS NULL OR trim(o_orderpriority) = ''")
def _(spark, d):
    return R.search(gappy_orders(spark, d), "", "o_orderpriority")


@query("search_not_missing", f"SELECT * FROM {GAPPY_SQL} g WHERE o_totalprice IS NOT NULL")
def _(spark, d):
    return R.search(gappy_orders(spark, d), "  ", "o_totalprice", exclude=True)


@query("search_blank_all", "SELECT * FROM nation")
def _(spark, d):
    return R.search(table(spark, d, "nation"), "")


@query("search_sorted", "SELECT * FROM part WHERE contains(lower(p_type), 'small') ORDER BY p_size DESC NULLS LAST, p_partkey")
def _(spark, d):
    return R.search_sorted(table(spark, d, "part"), "small", "p_size", "p_partkey", ascending=False, column="p_type")


@query("extract_rows", """
    SELECT o.* FROM orders o JOIN (VALUES (7, 0), (3, 1), (120, 2), (42, 3)) v(id, pos) ON o_orderkey = id ORDER BY pos""")
def _(spark, d):
    return R.extract_rows(table(spark, d, "orders"), _LISTED, "o_orderkey")


@query("extract_rows_by_table", """
    SELECT o.* FROM orders o WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)""")
def _(spark, d):
    ids = table(spark, d, "lineitem").where("l_quantity = 50").select("l_orderkey", F.col("l_orderkey").alias("pos"))
    return R.extract_rows(table(spark, d, "orders"), ids, "o_orderkey")


@query("delete_rows", "SELECT * FROM orders WHERE o_orderkey NOT IN (7, 3, 120, 42, 99999999)")
def _(spark, d):
    return R.delete_rows(table(spark, d, "orders"), _LISTED, "o_orderkey")


@query("clear_rows", """
    SELECT s_suppkey, CASE WHEN s_suppkey NOT IN (7, 3, 120, 42) THEN s_name END AS s_name,
           CASE WHEN s_suppkey NOT IN (7, 3, 120, 42) THEN s_nationkey END AS s_nationkey,
           CASE WHEN s_suppkey NOT IN (7, 3, 120, 42) THEN s_acctbal END AS s_acctbal FROM supplier""")
def _(spark, d):
    return R.clear_rows(table(spark, d, "supplier"), _LISTED, "s_suppkey")


@query("insert_blank_rows", """
    WITH n AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier),
         a AS (SELECT r FROM n WHERE s_suppkey = 7)
    SELECT s_suppkey, s_name, n.r + CASE WHEN n.r > a.r THEN 3 ELSE 0 END AS row_no FROM n, a
    UNION ALL SELECT NULL, NULL, a.r + i FROM a, range(1, 4) t(i)""")
def _(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return R.insert_blank_rows(s, 7, "s_suppkey", "s_suppkey", side="below", count=3)


@query("append_blank_rows", """
    SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS row_no FROM customer
    UNION ALL SELECT NULL, NULL, n + i FROM (SELECT count(*) AS n FROM customer), range(1, 3) t(i)""")
def _(spark, d):
    return R.append_blank_rows(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", count=2)


@query("cell_updates", """
    SELECT p_partkey, CASE p_partkey WHEN 5 THEN 'renamed' WHEN 6 THEN NULL ELSE p_name END AS p_name,
           CASE p_partkey WHEN 5 THEN 12 WHEN 8 THEN NULL ELSE p_size END AS p_size FROM part""")
def _(spark, d):
    edits = [(5, "p_name", "first"), (5, "p_name", " renamed "), (5, "p_size", "12.9"), (6, "p_name", "  "),
             (8, "p_size", "many"), (99999999, "p_size", "1"), (5, "unknown", "x")]
    return R.apply_updates(table(spark, d, "part").select("p_partkey", "p_name", "p_size"),
                           R.cell_updates(spark, edits), "p_partkey")


@query("cell_updates_from_table", """
    SELECT o_orderkey, CASE WHEN n IS NULL THEN o_custkey ELSE n END AS o_custkey FROM (
        SELECT o_orderkey, o_custkey, l.n FROM orders LEFT JOIN (
            SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 6) l
        ON o_orderkey = l_orderkey) x""")
def _(spark, d):
    busy = table(spark, d, "lineitem").groupBy("l_orderkey").count().where("count > 6")
    edits = busy.select(F.col("l_orderkey").cast("string").alias("row_id"), F.lit("o_custkey").alias("column"),
                        F.col("count").cast("string").alias("value"), F.lit(0).alias("seq"))
    return R.apply_updates(table(spark, d, "orders").select("o_orderkey", "o_custkey"), edits, "o_orderkey")


@query("clear_cells", "SELECT n_nationkey, CASE WHEN n_nationkey <> 3 THEN n_name END AS n_name, n_regionkey FROM nation")
def _(spark, d):
    return R.clear_cells(table(spark, d, "nation"), [(3, "n_name"), (99, "n_name")], "n_nationkey")


@query("unreadable_updates", "SELECT p_partkey AS row_id, 'p_size' AS \"column\", p_name AS value FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    edits = p.select(F.col("p_partkey").cast("string").alias("row_id"), F.lit("p_size").alias("column"),
                     F.col("p_name").alias("value"), F.lit(0).alias("seq"))
    return R.unreadable_updates(p, edits, "p_partkey")


@query("drop_missing_rows", f"""
    SELECT * FROM {GAPPY_SQL} g WHERE o_totalprice IS NOT NULL AND trim(o_orderpriority) <> ''""")
def _(spark, d):
    return R.drop_missing_rows(gappy_orders(spark, d))


@query("drop_missing_rows_subset", f"SELECT * FROM {GAPPY_SQL} g WHERE o_totalprice IS NOT NULL")
def _(spark, d):
    return R.drop_missing_rows(gappy_orders(spark, d), ["o_totalprice", "unknown"])


@query("find_replace_ignore_case", r"SELECT p_partkey, regexp_replace(p_name, 'bolt', 'N$1\\ut', 'gi') AS p_name FROM part"
       .replace(r"N$1\\ut", "NUT$"))
def _(spark, d):
    return R.find_replace(table(spark, d, "part").select("p_partkey", "p_name"), "BOLT", "NUT$", columns="p_name")


@query("find_replace_match_case", "SELECT doc_id, replace(text, 'The', '<THE>') AS text FROM documents")
def _(spark, d):
    return R.find_replace(table(spark, d, "documents").select("doc_id", "text"), "The", "<THE>", columns=["text"], match_case=True)


@query("find_replace_numbers", """
    SELECT p_partkey, CASE WHEN contains(CAST(p_size AS VARCHAR), '1') THEN 'one' ELSE CAST(p_size AS VARCHAR) END AS p_size
    FROM part""")
def _(spark, d):
    return R.find_replace(table(spark, d, "part").select("p_partkey", "p_size"), "1", "one", columns="p_size")


@query("find_replace_rows", """
    SELECT c_custkey, CASE WHEN c_custkey IN (7, 3, 120, 42) THEN replace(c_name, 'Customer', 'Client') ELSE c_name END AS c_name
    FROM customer""")
def _(spark, d):
    return R.find_replace(table(spark, d, "customer").select("c_custkey", "c_name"), "customer", "Client",
                          columns=["c_name"], ids=_LISTED, row_id="c_custkey")


@query("preview_rows", "SELECT count(*) AS rows FROM (SELECT * FROM orders LIMIT 50) o")
def _(spark, d):
    return R.preview(table(spark, d, "orders"), 50).agg(F.count(F.lit(1)).alias("rows"))


@query("transform_function", "SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey")
def _(spark, d):
    return R.apply_function(table(spark, d, "orders"), lambda o: o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders")))


@query("normalized_key", "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS key FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("double").alias("x"))
    return s.select("s_suppkey", lookup_key(F.col("x"), s.schema["x"].dataType).alias("key"))


# Amounts from 1e6 to 1e8 and shares below 1e-3: text without exponents.
_AMOUNTS_SQL = "(SELECT o_orderkey, o_totalprice * 100 AS amount, 1 / o_totalprice AS share FROM orders)"


def _amounts(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") * 100).alias("amount"), (1 / F.col("o_totalprice")).alias("share"))


@query("search_large_numbers", f"SELECT * FROM {_AMOUNTS_SQL} a WHERE contains(CAST(amount AS VARCHAR), '99')")
def _(spark, d):
    return R.search(_amounts(spark, d), "99", "amount")


@query("search_small_numbers", f"""
    SELECT o_orderkey FROM {_AMOUNTS_SQL} a WHERE contains(CAST(share AS VARCHAR), '0.0001') OR contains(CAST(share AS VARCHAR), '5e-0')""")
def _(spark, d):
    amounts = _amounts(spark, d)
    found = [R.search(amounts, text, "share").select("o_orderkey") for text in ("0.0001", "5E-0")]
    return found[0].union(found[1]).distinct()


_POWERS = [10.0 ** k for k in range(-12, 16)]
_SPREAD_SQL = f"(SELECT o_orderkey, o_totalprice * {_POWERS}[1 + o_orderkey % {len(_POWERS)}] AS v FROM orders)"


def _spread(spark, d):
    """Numbers from 1e-10 to 1e20."""
    power = F.get(F.array(*[F.lit(p) for p in _POWERS]), F.pmod("o_orderkey", F.lit(len(_POWERS))).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * power).alias("v"))


@query("search_exponents", f"SELECT o_orderkey, v FROM {_SPREAD_SQL} s WHERE contains(CAST(v AS VARCHAR), '3e+1') OR contains(CAST(v AS VARCHAR), 'e-07')")
def _(spark, d):
    spread = _spread(spark, d)
    return R.search(spread, "3e+1", "v").union(R.search(spread, "e-07", "v")).distinct()


@query("replace_exponents", f"SELECT o_orderkey, CASE WHEN contains(CAST(v AS VARCHAR), 'e') THEN 'x10^' ELSE CAST(v AS VARCHAR) END AS v FROM {_SPREAD_SQL} s")
def _(spark, d):
    return R.find_replace(_spread(spark, d), "e", "x10^", columns="v")


@query("replace_in_large_numbers", f"""
    SELECT o_orderkey, CASE WHEN contains(CAST(amount AS VARCHAR), '123') THEN 'found' ELSE CAST(amount AS VARCHAR) END AS amount
    FROM {_AMOUNTS_SQL} a""")
def _(spark, d):
    return R.find_replace(_amounts(spark, d).select("o_orderkey", "amount"), "123", "found", columns="amount")


@query("search_no_number", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND contains(CAST(o_totalprice AS VARCHAR), '77')")
def _(spark, d):
    """NaN is no value and matches no text."""
    gap = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("gap")
    o = table(spark, d, "orders").select("o_orderkey", gap)
    return R.search(o, "77", "gap").union(R.search(o, "nan", "gap")).select("o_orderkey")
