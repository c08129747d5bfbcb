"""Column names with dots, blanks, quotes and other scripts go through every kind of operator."""
import pytest

from tablewright.operators import (
    charts as K, columns as C, duplicates as D, fill as L, grouping as G, impute as I, joins as J, outliers as O,
    profile as P, relations as R, report as T, rows as W)
from tablewright.operators.ordering import stable_sort, with_row_number

KEY, TEXT, NUM, OTHER = "no.", "이름 값", "a.b`c", "x y"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, "u" if i % 3 else " ", float(i % 5) if i % 4 else None, float(i)) for i in range(30)]
    return spark.createDataFrame(rows, "k long, t string, n double, o double").toDF(KEY, TEXT, NUM, OTHER)


CASES = {
    "convert": lambda t: C.convert_type(t, NUM, "int"),
    "rename": lambda t: C.rename_column(t, NUM, "p.q"),
    "delete": lambda t: C.delete_columns(t, [NUM]),
    "insert": lambda t: C.insert_column(t, NUM, "left", "new.one", 1),
    "copy": lambda t: C.duplicate_column(t, NUM),
    "merge": lambda t: C.merge_columns(t, [TEXT, OTHER], "m.m", separator="."),
    "split": lambda t: C.split_column(t, OTHER, ".", prefix="part.no"),
    "clear": lambda t: C.clear_columns(t, [NUM]),
    "sequence": lambda t: C.fill_sequence(t, NUM, KEY),
    "search": lambda t: W.search(t, "u", TEXT),
    "extract": lambda t: W.extract_rows(t, [1, 2], KEY),
    "update": lambda t: W.apply_updates(t, W.cell_updates(t.sparkSession, [(1, NUM, "4")]), KEY),
    "blank rows": lambda t: W.insert_blank_rows(t, 3, KEY, KEY),
    "replace": lambda t: W.find_replace(t, "u", "v", ids=[1], row_id=KEY),
    "missing": lambda t: W.drop_missing_rows(t),
    "carry": lambda t: L.fill_missing(t, NUM, "bfill", order_by=KEY),
    "median": lambda t: L.fill_missing(t, NUM, "median"),
    "mode": lambda t: L.fill_missing(t, TEXT, "mode"),
    "first rows": lambda t: D.drop_duplicates(t, NUM, KEY),
    "repeated": lambda t: D.duplicate_rows(t, [NUM, TEXT]),
    "report of repeats": lambda t: D.duplicate_report(t, [NUM, TEXT]),
    "join": lambda t: J.join_tables(t, t, KEY, KEY),
    "lookup": lambda t: J.lookup_column(t, t, KEY, KEY, NUM, KEY, "found.it"),
    "enrich": lambda t: J.enrich(t, t, KEY, KEY, KEY),
    "stack": lambda t: J.stack_tables([t, t], order_by=KEY, number="row.no"),
    "group": lambda t: G.group_summary(t, [TEXT], NUM, "median"),
    "group sum": lambda t: G.group_summary(t, [TEXT], NUM, "sum"),
    "group first": lambda t: G.group_summary(t, [TEXT], NUM, "first", order_by=KEY),
    "describe": lambda t: G.describe_groups(t, TEXT, NUM),
    "top": lambda t: G.top_values(t, TEXT),
    "means": lambda t: G.mean_per_category(t, TEXT, NUM, KEY),
    "overview": lambda t: P.column_overview(t),
    "summary": lambda t: P.numeric_summary(t),
    "sample": lambda t: P.plot_sample(t, KEY, rows=5),
    "correlation": lambda t: R.correlation(t, NUM, OTHER),
    "matrix": lambda t: R.correlation_matrix(t),
    "crosstab": lambda t: R.crosstab(t, TEXT, NUM),
    "components": lambda t: R.principal_components(t, [NUM, OTHER], keep=[KEY])[0],
    "histogram": lambda t: K.histogram(t, NUM, 3),
    "density": lambda t: K.violin_density(t, TEXT, NUM, KEY),
    "boxes": lambda t: K.box_by_category(t, TEXT, NUM, KEY),
    "pair plot": lambda t: K.pair_plot_histograms(t, [NUM, OTHER], KEY),
    "outliers": lambda t: O.drop_outliers(t, [NUM, OTHER]),
    "outlier sample": lambda t: O.outlier_sample(t, [NUM, OTHER], KEY),
    "forest": lambda t: O.with_outlier_flag(t, [OTHER], "isolation_forest", order_by=KEY),
    "neighbours": lambda t: I.fill_knn(t, [NUM, OTHER]),
    "regressions": lambda t: I.fill_mice(t, [NUM, OTHER], max_iter=1),
    "insights": lambda t: T.Report(t).insights,
    "sort": lambda t: stable_sort(t, NUM, KEY),
    "numbers": lambda t: with_row_number(t, KEY, "n", rows_per_range=5),
}


@pytest.mark.parametrize("case", CASES)
def test_odd_names(odd, case):
    CASES[case](odd).collect()


def test_row_counts_stay(odd):
    for case in ("convert", "merge", "split", "sequence", "replace", "carry", "neighbours", "regressions", "lookup"):
        assert CASES[case](odd).count() == odd.count(), case
