"""Session helpers: shared scratch folder, lineage cuts, bounded driver reads."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession


#: Cells (rows x columns) of a partition that a model is fitted on.
FIT_CELLS = 500_000

#: Paths handed out by `scratch_path` and not deleted yet.
_SCRATCH: list[str] = []


def local_session(cores: str | int = "*", app: str = "panelspark",
                  shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`.

    A local session that names none gets a fresh local folder; on a cluster that
    is an error, since each machine would write to its own disk.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="panelspark-"))
        current = sc.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = os.path.join(shared_dir(spark), "panelspark", f"{name}-{uuid.uuid4().hex}")
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Delete all tables this program has put under the shared folder; results read from them must be written before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)


def fit_partitions(rows: int, width: int) -> int:
    """Partitions to fit a model on: they grow with the data, and equal data gives an equal number."""
    return max(1, -(-rows * max(width, 1) // FIT_CELLS))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` reliably so that later stages never recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Rows of a table that must be small; fails instead of filling the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; raise the limit only if the driver can hold it.")
    return rows
