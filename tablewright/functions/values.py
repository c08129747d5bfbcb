"""Scalar conversions between cell text and typed columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from ..constants import COLUMN_TYPES, EDIT_FALSE_WORDS, EDIT_TRUE_WORDS, FALSE_WORDS, TRUE_WORDS
from .missing import as_text, is_floating, is_integer, is_number, is_text

_WIDE = "decimal(38,0)"


def spark_type_for(name: str) -> str:
    """Spark type of a selectable type name or alias."""
    try:
        return COLUMN_TYPES[name.strip()]
    except KeyError:
        raise ValueError(f"unsupported column type: {name}") from None


def _finite(c: Column) -> Column:
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def as_boolean(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def convert(c: Column, source: T.DataType, target: str) -> Column:
    """Convert to a selectable type; what cannot be read becomes NULL, nothing raises."""
    kind = spark_type_for(target)
    if kind == "string":
        return as_text(F.when(~F.isnan(c), c) if is_floating(source) else c, source)
    if kind == "boolean":
        return c if isinstance(source, T.BooleanType) else as_boolean(c)
    if kind == "bigint":
        if is_integer(source):
            return c.cast("bigint")
        rounded = F.rint(_finite(c)).try_cast("bigint")  # halves go to the even neighbour
        return F.coalesce(c.try_cast("bigint"), rounded) if is_text(source) else rounded
    if kind == "double":
        return _finite(c)
    if is_number(source):  # numbers are nanoseconds since the epoch
        return F.timestamp_micros((c / 1000).try_cast("bigint")).cast("timestamp_ntz")
    return c.try_cast("timestamp_ntz")


def parse_cell(text: Column, dtype: T.DataType) -> Column:
    """Read edited text for a column of ``dtype``: blank or unreadable text gives NULL."""
    trimmed = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    filled = F.when(trimmed != "", trimmed)
    if is_text(dtype):
        return filled
    if isinstance(dtype, T.BooleanType):
        word = F.lower(filled)
        return F.when(word.isin(*EDIT_TRUE_WORDS), True).when(word.isin(*EDIT_FALSE_WORDS), False)
    if is_integer(dtype):
        # A long keeps all its digits; other spellings ("3.9", "1e3") are cut towards zero.
        number = _finite(filled)
        cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
        return F.coalesce(filled.try_cast(dtype), cut.try_cast(dtype))
    if is_number(dtype):
        return F.when(_finite(filled).isNotNull(), filled.try_cast(dtype))
    return filled.try_cast(dtype)


def _whole_number_text(c: Column) -> Column:
    return F.when(c == F.floor(c), c.try_cast(_WIDE).cast("string"))


def lookup_key(c: Column, dtype: T.DataType) -> Column:
    """Key text as a spreadsheet compares it: 13, 13.0 and ' 13 ' are one key; blanks are none."""
    if isinstance(dtype, T.BooleanType) or is_integer(dtype):
        return as_text(c, dtype)
    if is_number(dtype):
        value = F.when(~F.isnan(c), c) if is_floating(dtype) else c
        return F.coalesce(_whole_number_text(value), as_text(value, dtype))
    text = F.regexp_replace(c.cast("string"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.when(text != "", text)


def value_label(c: Column, dtype: T.DataType) -> Column:
    """Text for a listed value: whole floats without the fraction, no value as ''."""
    if is_floating(dtype):
        text = F.coalesce(_whole_number_text(c), as_text(F.when(~F.isnan(c), c), dtype))
    else:
        text = as_text(c, dtype)
    return F.coalesce(text, F.lit(""))
