"""Equi-joins with spreadsheet and data-frame column rules, lookups, and stacking."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import ENRICH_SUFFIX, LEFT_RIGHT_SUFFIXES, PREVIEW_ROWS
from ..functions.missing import data_type, is_number, is_text, known
from ..functions.naming import col, require_column, unique_name
from ..functions.values import lookup_key
from .ordering import order_key
from .skew import first_per_key, join_lookup

_JOINS = ("inner", "left", "right", "outer")


def _list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def join_tables(
    left: DataFrame,
    right: DataFrame,
    left_on: str | Sequence[str],
    right_on: str | Sequence[str],
    how: str = "inner",
    suffixes: tuple[str, str] = LEFT_RIGHT_SUFFIXES,
) -> DataFrame:
    """Join on equal keys; missing keys match each other.

    A key with one name on both sides becomes one column, keys with different names are both kept, and
    other names found on both sides get the suffixes. Both inputs reach the join straight from a
    shuffle, so adaptive execution can broadcast a small side or split a skewed key.
    """
    lkeys, rkeys = _list(left_on), _list(right_on)
    if how not in _JOINS:
        raise ValueError(f"unsupported join: {how}")
    if not lkeys or len(lkeys) != len(rkeys):
        raise ValueError("both sides need the same number of key columns")
    for table, keys in ((left, lkeys), (right, rkeys)):
        for k in keys:
            require_column(table, k)
    for a, b in zip(lkeys, rkeys):
        if is_text(data_type(left, a)) != is_text(data_type(right, b)):
            raise ValueError(f"key columns {a!r} and {b!r} hold text and another type")
    shared = {a for a, b in zip(lkeys, rkeys) if a == b}
    clash = (set(left.columns) & set(right.columns)) - shared
    lnames = {c: f"__l{i}" for i, c in enumerate(left.columns)}
    rnames = {c: f"__r{i}" for i, c in enumerate(right.columns)}
    # NaN is no key value; only keys are normalised, other columns pass through untouched.
    l = left.select(*[(known(left, c) if c in lkeys else col(c)).alias(n) for c, n in lnames.items()])
    r = right.select(*[(known(right, c) if c in rkeys else col(c)).alias(n) for c, n in rnames.items()])
    on = [F.col(lnames[a]).eqNullSafe(F.col(rnames[b])) for a, b in zip(lkeys, rkeys)]
    joined = l.join(r, on, "left" if how == "outer" else how)
    if how == "outer":
        # A full join cannot be broadcast or split; a left join and the unmatched right rows can.
        seen = l.select(*[F.col(lnames[a]).alias(rnames[b]) for a, b in zip(lkeys, rkeys)]).distinct()
        marked = join_lookup(r, seen.withColumn("__seen", F.lit(True)), [rnames[b] for b in rkeys], null_safe=True)
        joined = joined.unionByName(marked.where("__seen is null").drop("__seen"), allowMissingColumns=True)
    out: list[Column] = []
    for c, n in lnames.items():
        if c in shared:
            value = {"right": F.col(rnames[c]), "outer": F.coalesce(F.col(n), F.col(rnames[c]))}.get(how, F.col(n))
            out.append(value.alias(c))
        else:
            out.append(F.col(n).alias(c + suffixes[0] if c in clash else c))
    out += [F.col(n).alias(c + suffixes[1] if c in clash else c) for c, n in rnames.items() if c not in shared]
    return joined.select(*out)


def _keyed(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.withColumn(name, lookup_key(col(key), data_type(df, key)))


def lookup_column(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    take: str,
    right_order: str | Sequence[str],
    name: str | None = None,
) -> DataFrame:
    """Add (or overwrite) a column with the first match of each key in the right table.

    Every left row stays; a missing key finds nothing.
    """
    lkey, rkey = require_column(left, left_key), require_column(right, right_key)
    value = require_column(right, take)
    target = str(name or take).strip()
    if not target:
        raise ValueError("the looked-up column needs a name")
    taken = [*left.columns, *right.columns]
    key, found = unique_name(taken, "__lookup"), unique_name(taken, "__found")
    firsts = first_per_key(
        _keyed(right, rkey, key).where(col(key).isNotNull()), [key], order_key(right, right_order))
    joined = join_lookup(_keyed(left, lkey, key), firsts.select(key, col(value).alias(found)), [key])
    if target in left.columns:
        return joined.select(*[col(found).alias(c) if c == target else col(c) for c in left.columns])
    return joined.select(*[col(c) for c in left.columns], col(found).alias(target))


def lookup_stats(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row (total, matched, unmatched); an unknown key column matches nothing."""
    total = F.count(F.lit(1)).alias("total")
    if left_key not in left.columns or right_key not in right.columns:
        return left.agg(total, F.lit(0).cast("bigint").alias("matched"), F.count(F.lit(1)).alias("unmatched"))
    # Counting per key first leaves one row per key for the join, whatever the skew.
    per_key = _keyed(left, left_key, "__lookup").groupBy("__lookup").agg(F.count(F.lit(1)).alias("n"))
    keys = _keyed(right, right_key, "__lookup").select("__lookup").distinct()
    keys = keys.where("__lookup is not null").withColumn("hit", F.lit(True))
    joined = per_key.join(keys, "__lookup", "left")
    matched = F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return joined.agg(total.alias("total"), matched.alias("matched"), (total - matched).alias("unmatched"))


def enrich(
    base: DataFrame,
    extra: DataFrame,
    left_on: str,
    right_on: str,
    extra_order: str | Sequence[str],
) -> DataFrame:
    """Left join the first ``extra`` row per normalised key; clashing names get a suffix."""
    lkey, rkey = require_column(base, left_on), require_column(extra, right_on)
    for table, label in ((base, "base"), (extra, "extra")):
        if table.isEmpty():
            raise ValueError(f"the {label} table is empty")
    key = unique_name([*base.columns, *extra.columns], "__lookup")
    firsts = first_per_key(
        _keyed(extra, rkey, key).where(col(key).isNotNull()), [key], order_key(extra, extra_order))
    bring = [c for c in extra.columns if c != rkey]
    firsts = firsts.select(key, *[
        col(c).alias(c + ENRICH_SUFFIX if c in base.columns else c) for c in bring])
    joined = join_lookup(_keyed(base, lkey, key), firsts, [key])
    return joined.drop(key)


def _one_type(tables: Sequence[DataFrame]) -> list[DataFrame]:
    """A column whose types differ between tables (other than numbers) becomes text in all of them."""
    types: dict[str, set] = {}
    for t in tables:
        for f in t.schema:
            types.setdefault(f.name, set()).add(f.dataType)
    mixed = {n for n, kinds in types.items() if len(kinds) > 1 and not all(map(is_number, kinds))}
    return [t.withColumns({c: col(c).cast("string") for c in t.columns if c in mixed}) if mixed else t for t in tables]


def stack_tables(
    tables: Sequence[DataFrame],
    *,
    order_by: str | Sequence[str] | None = None,
    number: str | None = None,
) -> DataFrame:
    """Union by name; a column a table lacks is NULL there.

    With ``number`` the rows are renumbered: table by table, each in ``order_by`` order.
    """
    if not tables:
        raise ValueError("no tables to stack")
    tables = _one_type(tables)
    part = unique_name([c for t in tables for c in t.columns], "__table")
    if number is None:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t, allowMissingColumns=True)
        return out
    from .ordering import with_row_number

    tagged = [t.withColumn(part, F.lit(i)) for i, t in enumerate(tables)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return with_row_number(out, [part, *order_key(out, order_by)], number).drop(part)


def join_preview(left: DataFrame, right: DataFrame, *args, rows: int = PREVIEW_ROWS, **options) -> DataFrame:
    """The join of the first rows of both tables, so it may miss matches."""
    return join_tables(left.limit(rows), right.limit(rows), *args, **options)


def stack_preview(tables: Sequence[DataFrame], *, rows: int = PREVIEW_ROWS) -> DataFrame:
    return stack_tables([t.limit(rows) for t in tables])


def lookup_preview(left: DataFrame, right: DataFrame, *args, rows: int = PREVIEW_ROWS, **options) -> DataFrame:
    return lookup_column(left.limit(rows), right, *args, **options)
