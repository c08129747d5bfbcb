"""Limits, labels and word lists that decide results."""
from __future__ import annotations

# Default names and labels.
NEW_COLUMN_NAME = "새열"
OTHER_LABEL = "기타"
FOREST_LABEL = "전체 행 (Isolation Forest)"
LEFT_RIGHT_SUFFIXES = ("_left", "_right")
ENRICH_SUFFIX = "_crawl"
MULTI_VALUE_SEPARATOR = " | "

# Words read as booleans when a column is converted.
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f")

# Words read as booleans when a typed cell is edited.
EDIT_TRUE_WORDS = ("true", "1", "yes", "y")
EDIT_FALSE_WORDS = ("false", "0", "no", "n")

# Selectable column types and their aliases, mapped to Spark types.
COLUMN_TYPES = {
    "object": "string",
    "string": "string",
    "str": "string",
    "text": "string",
    "int64": "bigint",
    "int": "bigint",
    "float64": "double",
    "float": "double",
    "bool": "boolean",
    "bool_": "boolean",
    "datetime64[ns]": "timestamp_ntz",
    "datetime": "timestamp_ntz",
}

# Limits of listings, samples and report sections.
MAX_CATEGORIES = 30
PLOT_ROWS = 5000
PREVIEW_ROWS = 50
REPORT_CATEGORY_TOP = 10
STRONG_CORRELATION = 0.7
OUTLIER_SAMPLE_ROWS = 100
OUTLIER_SAMPLE_COLUMNS = 6
SEED = 42
