"""Value codes made comparable across waves."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import recode, truncated_code


def harmonize(df: DataFrame, codes: Mapping[str, Mapping[int, int]], text: bool = False) -> DataFrame:
    """Recode the features listed for one wave; all other columns are left alone."""
    found = {f: recode(F.col(f), m, text, df.schema[f].dataType) for f, m in codes.items() if f in df.columns}
    return df.withColumns(found) if found else df


def harmonize_waves(df: DataFrame, crosswalk: Mapping[int, Mapping[str, Mapping[int, int]]],
                    wave: str = "wave", text: bool = False) -> DataFrame:
    """Recode a table of all waves in one projection: no join, no shuffle."""
    changed = {}
    for feature in df.columns:
        col = F.col(feature)
        keep = col.cast("string") if text else col
        rule = None
        for w, features in crosswalk.items():
            if feature in features:
                step = recode(col, features[feature], text, df.schema[feature].dataType)
                rule = F.when(F.col(wave) == w, step) if rule is None else rule.when(F.col(wave) == w, step)
        if rule is not None:
            changed[feature] = rule.otherwise(keep)
    return df.withColumns(changed) if changed else df


def harmonize_long(df: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Recode a long `(wave, feature, code)` table by a crosswalk table of any size."""
    found = df.withColumn("_code", truncated_code(F.col("code"), df.schema["code"].dataType)).join(
        crosswalk.select("wave", "feature", F.col("code_from").alias("_code"), "code_to"),
        ["wave", "feature", "_code"], "left")
    return found.withColumn("code", F.coalesce("code_to", "_code")).drop("_code", "code_to")


def code_set_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Codes added, dropped or relabelled between two `(feature, code, label)` tables."""
    joined = before.withColumnRenamed("label", "label_before").join(
        after.withColumnRenamed("label", "label_after"), ["feature", "code"], "full_outer")
    change = (F.when(F.col("label_before").isNull(), "added")
              .when(F.col("label_after").isNull(), "dropped")
              .when(F.col("label_before") != F.col("label_after"), "relabelled").otherwise("same"))
    return joined.select("feature", "code", "label_before", "label_after", change.alias("change"))


def labels_from_json(df: DataFrame, feature: str, labels: str) -> DataFrame:
    """Explode a JSON object column `{code: label}` into `(feature, code, label)` rows."""
    parsed = F.from_json(F.col(labels), "map<string,string>")
    return df.select(F.col(feature).alias("feature"), F.explode(parsed).alias("code", "label"))
