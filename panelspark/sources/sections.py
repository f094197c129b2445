"""Survey section files: per-wave layout and CSV scans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WaveLayout:
    """Where one wave keeps its sections, ids and renamed columns."""

    wave: int
    hhid: str
    indid: str
    files: dict[str, str]
    columns: dict[str, str | None] = field(default_factory=dict)
    rural_source: str | None = None


# Section files of waves 3 to 5.
_STANDARD_FILES = {"A": "HH_SEC_A.csv", "B": "HH_SEC_B.csv", "C": "HH_SEC_C.csv", "I": "HH_SEC_I.csv"}

# File, id and column names of each wave.
LAYOUTS = {
    1: WaveLayout(
        1, "hhid", "sbmemno",
        {"A": "SEC_A_T.csv", "B": "SEC_B_C_D_E1_F_G1_U.csv",
         "C": "SEC_B_C_D_E1_F_G1_U.csv", "I": "SEC_H1_J_K2_O2_P1_Q1_S1.csv"},
        {"hh_b02": "sbq2", "hh_b04": "sbq4", "hh_b05": "sbq5",
         "hh_c01": "scq1", "hh_c07": "scq6", "hh_c09": "scq7",
         "hh_i01": "sjq1", "hh_i09": "sjq3_1", "hh_i10": "sjq6", "hh_i11": "sjq15",
         "hh_i12": "sjq16", "hh_i15": None, "hh_i17": "sjq18", "hh_i18": "sjq19",
         "hh_i19": "sjq8", "hh_a01_1": "region", "clustertype": None},
        "locality"),
    2: WaveLayout(
        2, "y2_hhid", "indidy2",
        {"A": "HH_SEC_A.csv", "B": "HH_SEC_B.csv", "C": "HH_SEC_C.csv", "I": "HH_SEC_J1.csv"},
        {"hh_i01": "hh_j01", "hh_i09": "hh_j04_1", "hh_i10": "hh_j07", "hh_i11": "hh_j09",
         "hh_i12": "hh_j10", "hh_i15": None, "hh_i17": "hh_j17", "hh_i18": "hh_j18",
         "hh_i19": "hh_j19", "hh_a01_1": "region", "clustertype": None},
        "y2_rural"),
    3: WaveLayout(3, "y3_hhid", "indidy3", _STANDARD_FILES),
    4: WaveLayout(4, "y4_hhid", "indidy4", _STANDARD_FILES),
    5: WaveLayout(5, "y5_hhid", "indidy5", _STANDARD_FILES),
}


def wave_layout(wave: int) -> WaveLayout:
    if wave not in LAYOUTS:
        raise KeyError(f"No layout for wave {wave}; known waves are {sorted(LAYOUTS)}.")
    return LAYOUTS[wave]


def section_path(spark: SparkSession, root: str, wave: int, section: str) -> str:
    """Path of a section file under `root/wave{N}/household/`, checked on its own file system."""
    path = f"{root}/wave{wave}/household/{wave_layout(wave).files[section]}"
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        raise FileNotFoundError(f"Missing section {section} of wave {wave}: {path}")
    return path


def read_csv(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """A headed CSV; text columns by default, as coercion happens per feature.

    `infer=True` types whole columns at the price of one more pass over the file.
    """
    return spark.read.csv(path, header=True, inferSchema=infer, encoding="UTF-8")


def read_section(spark: SparkSession, root: str, wave: int, section: str, infer: bool = False) -> DataFrame:
    return read_csv(spark, section_path(spark, root, wave, section), infer)


def read_sections(spark: SparkSession, root: str, wave: int, infer: bool = False) -> dict[str, DataFrame]:
    """All sections of a wave; sections that share a file share one DataFrame."""
    by_file: dict[str, DataFrame] = {}
    sections = {}
    for section, name in wave_layout(wave).files.items():
        if name not in by_file:
            by_file[name] = read_section(spark, root, wave, section, infer)
        sections[section] = by_file[name]
    return sections


def union_waves(tables: dict[int, DataFrame]) -> DataFrame:
    """One table of all waves, `wave` as a column; features a wave lacks are NULL."""
    stacked = None
    for wave, df in sorted(tables.items()):
        tagged = df.select(F.lit(wave).alias("wave"), *df.columns)
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    if stacked is None:
        raise ValueError("No waves to union.")
    return stacked
