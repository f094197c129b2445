"""One row per household from section tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark import spec
from panelspark.functions.columns import to_number
from panelspark.operators.harmonize import harmonize
from panelspark.sources.sections import WaveLayout, read_sections, union_waves, wave_layout


def present_columns(columns: Iterable[str], features: Sequence[spec.Feature], layout: WaveLayout) -> dict[str, str]:
    """Wanted columns that exist, as {column in the file: feature name}."""
    available = set(columns)
    found = {}
    for f in features:
        actual = layout.columns.get(f.column, f.column)
        if actual is not None and actual in available:
            found[actual] = f.name
    return found


def first_usable(df: DataFrame, candidates: Sequence[str | None]) -> str | None:
    """The first candidate that exists and has any value, decided for the whole column."""
    existing = [c for c in dict.fromkeys(candidates) if c and c in df.columns]
    if not existing:
        return None
    seen = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in existing]).first()
    return next((c for c in existing if seen[c]), None)


def _in_number_order(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Order by the number a column holds, and by its text where that is equal or no number; missing values last."""
    out = []
    for c in columns:
        number = to_number(F.col(c), df.schema[c].dataType)
        out += [number.isNull(), number, F.col(c).isNull(), F.col(c)]
    return out


def _least_row(order: Sequence[Column], payload: Sequence[str]) -> Column:
    parts = [o.alias(f"_o{i}") for i, o in enumerate(order)] + [F.col(c).alias(f"p_{c}") for c in payload]
    return F.min(F.struct(*parts))


def first_rows(df: DataFrame, key: str, order_by: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The first row of each key in a stated order.

    A minimum over a struct combines map-side, so a key that holds a large
    share of the rows never lands in one task. Full ties are equal in every
    payload column, since these close the order.
    """
    picked = df.groupBy(key).agg(_least_row(_in_number_order(df, order_by), payload).alias("_first"))
    return picked.select(key, *[F.col(f"_first.p_{c}").alias(c) for c in payload])


def head_rows(members: DataFrame, key: str, member: str, order_by: Sequence[str], payload: Sequence[str],
              head_value: int = 1, size_name: str | None = "household_size",
              heads_only: bool = True) -> DataFrame:
    """Head row and member count per household, both from one shuffle.

    The head is the member numbered `head_value`, else the first row in order.
    All rows count towards the size, not only the head's.
    """
    is_head = F.coalesce(to_number(F.col(member), members.schema[member].dataType) == head_value, F.lit(False))
    order = ([F.when(is_head, 0).otherwise(1)] if heads_only else []) + _in_number_order(members, order_by)
    aggs = [_least_row(order, payload).alias("_first")]
    if size_name:
        aggs.insert(0, F.count(F.lit(1)).alias(size_name))
    grouped = members.groupBy(key).agg(*aggs)
    return grouped.select(key, *([size_name] if size_name else []),
                          *[F.col(f"_first.p_{c}").alias(c) for c in payload])


def require_keys(df: DataFrame, key: str) -> DataFrame:
    """Fail on a missing household id instead of joining or dropping it silently."""
    return df.withColumn(key, F.when(F.col(key).isNotNull(), F.col(key)).otherwise(
        F.raise_error(F.lit(f"{key} must not be null")).cast(df.schema[key].dataType)))


def assemble_wave(sections: dict[str, DataFrame], wave: int, layout: WaveLayout,
                  heads_only: bool = True, order_by: Sequence[str] = ()) -> DataFrame:
    """Feature table of one wave: `hhid`, `household_size`, then features in registry order."""
    by_section = spec.features_by_section()
    hhid = layout.hhid
    a = sections["A"]
    wanted = present_columns(a.columns, by_section["A"], layout)
    rural = first_usable(a, [layout.rural_source, "clustertype", f"y{wave}_rural"])
    wanted.pop("clustertype", None)
    if rural:
        wanted[rural] = "rural_urban"
    tie = [c for c in order_by if c in a.columns]
    base = first_rows(require_keys(a, hhid), hhid, tie, list(wanted)).withColumnsRenamed(wanted)
    # Sections that share a file are found in one aggregation.
    for names in [("B", "C")] if sections["B"] is sections["C"] else [("B",), ("C",)]:
        df = sections[names[0]]
        found = present_columns(df.columns, [f for name in names for f in by_section[name]], layout)
        size = "household_size" if "B" in names else None
        tie = [c for c in order_by if c in df.columns]
        if layout.indid in df.columns:
            part = head_rows(require_keys(df, hhid), hhid, layout.indid, [*tie, layout.indid], list(found),
                             size_name=size, heads_only=heads_only)
        else:
            part = first_rows(df, hhid, tie, list(found))
            if size:
                part = part.join(df.groupBy(hhid).agg(F.count(F.lit(1)).alias(size)), hhid, "left")
        base = base.join(part.withColumnsRenamed(found), hhid, "left")
    housing = sections["I"]
    found = present_columns(housing.columns, by_section["I"], layout)
    tie = [c for c in order_by if c in housing.columns]
    base = base.join(first_rows(housing, hhid, tie, list(found)).withColumnsRenamed(found), hhid, "left")
    base = harmonize(base.withColumnRenamed(hhid, "hhid"), spec.CROSSWALK.get(wave, {}), text=True)
    return ordered(base, ["hhid", "household_size", *[f.name for f in spec.FEATURES]])


def ordered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns that exist, in the given order."""
    return df.select(*[c for c in columns if c in df.columns])


def load_wave(spark: SparkSession, root: str, wave: int, heads_only: bool = True,
              order_by: Sequence[str] = (), infer: bool = False) -> DataFrame:
    return assemble_wave(read_sections(spark, root, wave, infer), wave, wave_layout(wave), heads_only, order_by)


def load_waves(spark: SparkSession, root: str, waves: Sequence[int] = (1, 2, 3, 4, 5), **options) -> DataFrame:
    """All waves in one table; ids become text, as they differ in kind between waves."""
    tables = {w: load_wave(spark, root, w, **options) for w in waves}
    return union_waves({w: df.select(*[F.col(c).cast("string") if c != "household_size" else F.col(c)
                                       for c in df.columns]) for w, df in tables.items()})
