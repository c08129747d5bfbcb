"""Values, fields and batches taken from stored pages with CSS selectors."""
from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import MULTI_VALUE_SEPARATOR
from ..functions.missing import present
from ..functions.naming import col, require_column
from ..operators.ordering import order_key
from ..operators.skew import first_per_key, fits_broadcast, join_lookup
from .css import compile_selector
from .elements import Parsed, parse_pages


@dataclass(frozen=True)
class Field:
    name: str
    selector: str
    attr: str = "text"


# What a match can give, its text or one of these attributes.
GIVEN = ("text", "href", "src")


def _given(what: str | None) -> str:
    """The stated value of a match; nothing stated means the text."""
    stated = str(what or "").strip().lower() or "text"
    if stated not in GIVEN:
        raise ValueError(f"a match has no {what!r}; choose one of {', '.join(GIVEN)}")
    return stated


def _values(stated: Sequence[tuple[str, str | None]], limit: int | None = None):
    """A function of a page: for each (selector, what) the values of its matches in document order."""
    lists, given = [compile_selector(s) for s, _ in stated], [_given(w) for _, w in stated]

    def values(page: Parsed) -> list[list[str]]:
        return [[page.text(e) if what == "text" else e.attrs.get(what, "").strip() for e in (found if limit is None else found[:limit])]
                for what, found in zip(given, page.select(lists))]
    return values


def _column_name(column: str | None) -> str:
    return str(column or "").strip() or "value"


def extract_values(
    pages: DataFrame, selector: str, *, attr: str = "text", limit: int | None = None,
    column: str = "value", html: str = "html",
) -> DataFrame:
    """One row per match: the page's other columns, ``pos`` and the value. ``limit`` is per page."""
    name = _column_name(column)
    values = _values([(selector, attr)], None if limit is None or limit < 0 else limit)
    keep = [c for c in pages.columns if c != html]
    parsed = parse_pages(pages, html, [("__values", "array<string>")], lambda page: tuple(values(page)))
    return parsed.select(*[col(c) for c in keep], F.posexplode("__values").alias("pos", name))


def extract_table(pages: DataFrame, selector: str, *, column: str = "value", **options) -> DataFrame:
    """The matches alone, as a one-column table."""
    return extract_values(pages, selector, column=column, **options).select(col(_column_name(column)))


def parse_fields(text: str) -> list[Field]:
    """Field lines ``name|selector`` or ``name|selector|attr``; blank and # lines are skipped."""
    stated = [line for line in map(str.strip, str(text or "").splitlines()) if line and line[0] != "#"]
    if not stated:
        raise ValueError("no fields given")
    return [_field(*map(str.strip, line.split("|"))) for line in stated]


def _field(name: str = "", selector: str = "", attr: str = "", *more: str) -> Field:
    if not (name and selector):
        raise ValueError(f"a field needs a name and a selector, not {name!r} and {selector!r}")
    return Field(name, selector, _given(attr))


def _with_fields(pages: DataFrame, html: str, fields: Sequence[Field], join_multi: bool, separator: str) -> DataFrame:
    """The pages with one column for each field instead of the markup; all fields are found in one pass."""
    values = _values([(f.selector, f.attr) for f in fields], None if join_multi else 1)  # the first match alone counts, even when it is empty

    def make(page: Parsed) -> tuple[str, ...]:
        return tuple(separator.join(v for v in some if v) for some in values(page))

    keep = [c for c in pages.columns if c != html]
    parsed = parse_pages(pages, html, [(f"__field_{i}", "string") for i in range(len(fields))], make)
    return parsed.select(*[col(c) for c in keep], *[F.col(f"__field_{i}").alias(f.name) for i, f in enumerate(fields)])


def extract_fields(
    pages: DataFrame, fields: Sequence[Field], *, join_multi: bool = True,
    separator: str = MULTI_VALUE_SEPARATOR, html: str = "html",
) -> DataFrame:
    """One row per page with one column per field: its matches joined, '' for none."""
    return _with_fields(pages, html, fields, join_multi, separator)


# ---------------------------------------------------------------- batches

# Doubled braces, placeholders, single braces, and what lies between.
_PARTS = re.compile(r"\{\{|\}\}|\{\w+\}|[{}]|[^{}]+")


def url_from_template(template: str, params: dict[str, Column]) -> Column:
    """Fill ``{name}`` placeholders with columns; ``{{`` and ``}}`` are literal braces.

    A template that opens no brace is an address as it stands.
    """
    def filled(part: str) -> Column:
        if part in ("{{", "}}"):
            return F.lit(part[0])
        if part in ("{", "}"):
            raise ValueError(f"a brace without its partner in the URL template {template!r}")
        if not part.startswith("{"):
            return F.lit(part)
        if (name := part[1:-1]) not in params:
            raise ValueError(f"no column for {part} in the URL template")
        return params[name].cast("string")

    text = str(template or "").strip()
    if not text:
        raise ValueError("the URL template is empty")
    return F.concat(*map(filled, _PARTS.findall(text))) if "{" in text else F.lit(text)


def params_from_column(df: DataFrame, column: str, order_by: str | Sequence[str], name: str = "param") -> DataFrame:
    """Distinct trimmed texts of a column with the place of their first mention: (param, seen…)."""
    source = require_column(df, column)
    keys = order_key(df, order_by)
    text = F.regexp_replace(present(df, source).cast("string"), r"(?U)^\s+|\s+$", "")
    seen = F.min(F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)])).alias("seen")
    listed = df.select(text.alias(name), *[col(k) for k in keys if k != name]).where(col(name).isNotNull())
    return listed.groupBy(name).agg(seen).select(name, "seen.*")


def params_from_lines(df: DataFrame, text: str, order_by: str | Sequence[str], name: str = "param") -> DataFrame:
    """Parameters from text cells, one per line: blank and # lines dropped, first mentions kept."""
    keys = order_key(df, order_by)
    lines = df.select(
        *[col(k) for k in keys], F.posexplode(F.split(col(require_column(df, text)), r"\r\n|\r|\n")).alias("line_no", "__line"))
    trimmed = F.regexp_replace("__line", r"(?U)^\s+|\s+$", "").alias(name)
    lines = lines.select(*[col(k) for k in keys], "line_no", trimmed)
    lines = lines.where((col(name) != "") & ~col(name).startswith("#"))
    return params_from_column(lines, name, [*keys, "line_no"], name)


def extract_batch(
    params: DataFrame,
    pages: DataFrame,
    template: str,
    fields: Sequence[Field],
    *,
    param: str = "code",
    url: str = "url",
    html: str = "html",
    page_order: str | Sequence[str],
) -> DataFrame:
    """One row per parameter: (param, url, fields…, error). A page that is not stored gives an error text.

    Markup is never shuffled: pages are parsed where they are read, and only their fields travel. A small
    parameter list first picks the pages to parse.
    """
    if not fields:
        raise ValueError("no fields given")
    key = require_column(params, param)
    wanted = params.select(col(key), url_from_template(template, {key: col(key)}).alias("url"))
    keys = order_key(pages, page_order)
    stored = pages.select(col(url).alias("url"), *[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], col(html).alias("html"))
    listed = wanted.select("url").distinct()
    if fits_broadcast(listed):
        stored = stored.join(F.broadcast(listed), "url", "left_semi")  # size checked above
    taken = _with_fields(stored, "html", fields, True, MULTI_VALUE_SEPARATOR).withColumn("error", F.lit(""))
    taken = first_per_key(taken, ["url"], [f"__k{i}" for i in range(len(keys))]).drop(*[f"__k{i}" for i in range(len(keys))])
    joined = join_lookup(wanted, taken, ["url"])
    names = [f.name for f in fields]
    return joined.select(
        col(key), "url", *[F.coalesce(col(n), F.lit("")).alias(n) for n in names],
        F.coalesce("error", F.concat(F.lit("page not stored: "), "url"), F.lit("no URL: the parameter is missing")).alias("error"))
