"""Column-name helpers (driver-side work on ``df.columns`` only)."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def col(name: str) -> Column:
    """Reference a column literally, whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_column(df: DataFrame, name: object) -> str | None:
    """The column called ``name`` (compared as text), or None."""
    text = str(name)
    return text if text in df.columns else None


def require_column(df: DataFrame, name: object) -> str:
    found = resolve_column(df, name)
    if found is None:
        raise ValueError(f"no column named {name!r}")
    return found


def resolve_columns(df: DataFrame, names: Iterable[object]) -> list[str]:
    """Known columns among ``names``: request order, no repeats, unknown names dropped."""
    known = set(df.columns)
    return list(dict.fromkeys(str(n) for n in names if str(n) in known))


def unique_name(taken: Iterable[str], base: str) -> str:
    """``base``, or the first free one of ``base_1``, ``base_2`` …"""
    used = set(taken)
    if base not in used:
        return base
    n = 1
    while f"{base}_{n}" in used:
        n += 1
    return f"{base}_{n}"


def dedupe_names(names: Iterable[object]) -> list[str]:
    """Names as text; of equal names the later ones get the first number that makes no name of the list twice."""
    wanted = [str(n) for n in names]
    out: list[str] = []
    for at, name in enumerate(wanted):
        repeated = name in wanted[:at]
        out.append(unique_name({*out, *wanted}, name) if repeated else name)
    return out


def temp_name(df: DataFrame, base: str) -> str:
    return unique_name(df.columns, f"__{base}")
