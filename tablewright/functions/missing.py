"""The blank-aware missing-value test, and NaN handling."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .naming import col

# One visible character is enough to make a text present; the scan stops at the first one.
# Python's strip() also removes the four ASCII separators, which \s leaves out.
_VISIBLE = r"(?U)[^\s\x1c-\x1f]"


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_number(dtype: T.DataType) -> bool:
    """Numeric for statistics: every number type, not booleans."""
    return isinstance(dtype, T.NumericType)


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_number(f.dataType)]


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so that both mean "no value"."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_floating(data_type(df, name)) else c


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, NaN or, for text, nothing but white space. Never NULL itself."""
    c, dtype = col(name), data_type(df, name)
    if is_text(dtype):
        return c.isNull() | ~c.rlike(_VISIBLE)
    if is_floating(dtype):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The column with every missing value (blank text too) turned into NULL."""
    dtype = data_type(df, name)
    if is_text(dtype) or is_floating(dtype):
        return F.when(~is_missing(df, name), col(name))
    return col(name)


_SHORT = 64


def compact_key(c: Column, dtype: T.DataType) -> Column:
    """A stand-in for grouping and matching: long text as its length and SHA-256, anything else as it is.

    Whole texts decide, but only the digest travels. A digest key is longer than any short text, so the
    two never meet.
    """
    if not is_text(dtype):
        return c
    return F.when(F.length(c) <= _SHORT, c).otherwise(
        F.concat(F.length(c).cast("string"), F.lit(":"), F.sha2(c, 256)))


def any_missing(df: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [is_missing(df, n) for n in names], F.lit(False))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise a loaded table: NaN becomes NULL in every floating column."""
    floats = {f.name for f in df.schema if is_floating(f.dataType)}
    if not floats:
        return df
    return df.select(*[known(df, c).alias(c) if c in floats else col(c) for c in df.columns])


# Every digit of a double from 1e-4 to 1e16 fits: 17 places before the point, 21 behind it.
_PLAIN = "decimal(38,21)"


def as_text(c: Column, dtype: T.DataType) -> Column:
    """The value as displayed: booleans are True and False; doubles from 1e-4 to 1e16 have no exponent, others one of two
    digits at least (1e-05, 2.5e+18), and infinity is inf."""
    text = c.cast("string")
    if isinstance(dtype, T.BooleanType):
        return F.initcap(text)
    if not is_floating(dtype):
        return text
    # Long spellings may have digits too many: the fewest of 15 to 17 count that name the same number.
    places = F.length(F.regexp_replace(F.substring_index(text, "E", 1), r"[-.]|^-?0\.0*", ""))
    shortest = text
    for n in (17, 16, 15):
        shorter = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{n - 1}E", c), r"0*E\+?0*", "E"), r"\.E", ".0E")
        shortest = F.when((places > n) & (shorter.try_cast("double") == c.cast("double")), shorter).otherwise(shortest)
    text = shortest
    digits = F.regexp_replace(text.try_cast(_PLAIN).cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1)
    size = F.regexp_replace(power, "^-", "")
    spelled = F.concat(mantissa, F.when(power.startswith("-"), "e-").otherwise("e+"), F.when(F.length(size) < 2, F.lpad(size, 2, "0")).otherwise(size))
    return (F.when(text.contains("E"), F.when((F.abs(c) >= 1e-4) & (F.abs(c) < 1e16), plain).otherwise(spelled))
            .when(text.endswith("Infinity"), F.replace(text, F.lit("Infinity"), F.lit("inf"))).otherwise(text))


def category_text(df: DataFrame, name: str) -> Column:
    """A value as a category label; a missing value is a category of its own."""
    dtype = data_type(df, name)
    gap = "None" if is_text(dtype) else "NaT" if is_datetime(dtype) else "nan"
    return F.coalesce(as_text(known(df, name), dtype), F.lit(gap))
