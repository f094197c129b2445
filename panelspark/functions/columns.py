"""Scalar column expressions: coercion, recoding, labels, vector arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegralType, NumericType


def to_number(col: Column, dtype: DataType | None = None) -> Column:
    """DOUBLE value of anything; what does not parse, and NaN, is NULL.

    With a known numeric `dtype` no text is parsed.
    """
    if isinstance(dtype, (FloatType, DoubleType)):
        return F.when(~F.isnan(col), col.cast("double"))
    if isinstance(dtype, NumericType):
        return col.cast("double")
    number = F.trim(col.cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number)


def truncated_code(col: Column, dtype: DataType | None = None) -> Column:
    """Integer code, cut toward zero."""
    if isinstance(dtype, IntegralType):
        return col.cast("bigint")
    return to_number(col, dtype).try_cast("bigint")


def rounded_code(col: Column, dtype: DataType | None = None) -> Column:
    """Integer code, rounded half to even."""
    if isinstance(dtype, IntegralType):
        return col.cast("bigint")
    return F.bround(to_number(col, dtype), 0).try_cast("bigint")


def _lookup(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def recode(col: Column, codes: Mapping[int, int], text: bool = False, dtype: DataType | None = None) -> Column:
    """Map integer codes; unlisted codes keep their integer, text that is no number stays.

    `text=True` returns strings, so that non-numeric answers survive.
    """
    code = truncated_code(col, dtype)
    mapped = code
    if codes:
        table = F.create_map(*[F.lit(x).cast("bigint") for pair in codes.items() for x in pair])
        mapped = F.coalesce(F.try_element_at(table, code), code)
    if not text:
        return mapped
    return F.coalesce(mapped.cast("string"), col.cast("string"))


def value_of(col: Column, mapping: Mapping[str, str]) -> Column:
    """Lookup in a small fixed string table."""
    return F.try_element_at(_lookup(mapping), col)


def wave_label(wave: Column, years: Mapping[int, str]) -> Column:
    """`W4 (2014/15)`; a wave without a year is `W4`."""
    year = F.try_element_at(F.create_map(*[F.lit(x) for k, v in years.items() for x in (int(k), v)]),
                            wave.cast("int"))
    head = F.concat(F.lit("W"), wave.cast("string"))
    return F.when(year.isNull(), head).otherwise(F.concat(head, F.lit(" ("), year, F.lit(")")))


def as_percent(col: Column) -> Column:
    """Shares up to 1 become percents; larger values already are."""
    return F.when(col <= 1, col * 100).otherwise(col)


def clean_text(col: Column) -> Column:
    return F.lower(F.trim(col))


def absolute_gap(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def squared_distance(vector: Column, point: Sequence[float]) -> Column:
    other = F.array(*[F.lit(float(p)) for p in point])
    return F.aggregate(F.zip_with(vector, other, lambda a, b: (a - b) * (a - b)),
                       F.lit(0.0), lambda acc, x: acc + x)


def arithmetic_key(key: Column, seed: int) -> Column:
    """A repeatable number in [0, 2^31) by plain integer arithmetic on a BIGINT key."""
    base = F.pmod(key.cast("bigint"), F.lit(2147483648).cast("bigint"))
    return F.pmod(base * F.lit(1103515245).cast("bigint") + F.lit(12345 + 7919 * seed).cast("bigint"),
                  F.lit(2147483648).cast("bigint"))


def hashed_key(key: Column, seed: int) -> Column:
    """The default sampling number in [0, 2^31) for keys of any type."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2147483648).cast("bigint"))
