"""Numeric design matrix and missing-value accounting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from panelspark.functions.columns import to_number, truncated_code
from panelspark.runtime import bounded_rows


def _code_text(df: DataFrame, name: str) -> Column:
    """Codes as text, integers without decimals, so that names agree between waves."""
    column, dtype = F.col(name), df.schema[name].dataType
    code = truncated_code(column, dtype).cast("string")
    return code if isinstance(dtype, NumericType) else F.coalesce(code, column.cast("string"))


def _is_code(df: DataFrame, name: str, value: str) -> Column:
    """Whether a row gave this code; NULL where it gave none."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, NumericType):
        return truncated_code(F.col(name), dtype) == int(value)
    return _code_text(df, name) == value


def categories(df: DataFrame, columns: Sequence[str], limit: int = 10_000) -> dict[str, list[str]]:
    """Observed codes of each categorical column, in numeric then text order.

    The width of the matrix is the number of codes, so it is checked against `limit`.
    """
    if not columns:
        return {}
    long = df.select(*[_code_text(df, c).alias(c) for c in columns]).unpivot([], list(columns), "feature", "code")
    rows = bounded_rows(long.where("code is not null").distinct(), limit, "The set of category codes")
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in rows:
        found[row["feature"]].append(row["code"])

    def order(code: str):
        try:
            return (0, int(code), code)
        except ValueError:
            return (1, 0, code)

    return {c: sorted(codes, key=order) for c, codes in found.items()}


def dummy_names(cats: Mapping[str, Sequence[str]], drop_first: bool = False) -> list[str]:
    return [f"{f}_{code}" for f, codes in cats.items() for code in codes[1 if drop_first else 0:]]


def design_matrix(df: DataFrame, keys: Sequence[str], numeric: Sequence[str], cats: Mapping[str, Sequence[str]],
                  drop_first: bool = False) -> DataFrame:
    """Numeric columns, then one 0/1 column per code; a missing answer is missing in all its columns."""
    columns = [to_number(F.col(c), df.schema[c].dataType).alias(c) for c in numeric]
    for feature, codes in cats.items():
        for value in codes[1 if drop_first else 0:]:
            columns.append(_is_code(df, feature, value).cast("double").alias(f"{feature}_{value}"))
    return df.select(*keys, *columns)


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(columns))


def missing_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row `(n_rows, n_columns, missing_cells, complete_rows)` in a single pass."""
    gaps = sum((F.col(c).isNull().cast("bigint") for c in columns), F.lit(0).cast("bigint"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(columns)).cast("bigint").alias("n_columns"),
                  F.coalesce(F.sum(gaps), F.lit(0)).alias("missing_cells"),
                  F.count_if(gaps == 0).alias("complete_rows"))


def missing_rates(df: DataFrame, columns: Sequence[str], by: str = "wave") -> DataFrame:
    """Share of missing answers per feature and group, as a long table."""
    wide = df.groupBy(by).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([by], list(columns), "feature", "missing_rate")


def vector_column(columns: Sequence[str], name: str = "features"):
    """The design columns as one `array<double>`."""
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias(name)
