"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows of a reference table that is broadcast or read to the driver.
SMALL_ROWS = 50_000


def session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; existing settings win on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one set in the context or in spark.checkpoint.dir.

    Where none is set, a local session gets a folder of its own, deleted when Python ends; on a cluster it is an error, since a folder of one
    machine would not be found by the others.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="millrace-checkpoints-")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that a lost executor costs no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether df has at most that many rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df marked for broadcast if its size is within the bound, else df as it is (a shuffled join)."""
    return F.broadcast(df) if is_small(df, rows) else df


def small_rows(df: DataFrame, rows: int = SMALL_ROWS) -> list:
    """The rows of a reference table whose size is checked; refuses a larger one."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a reference table may have at most {rows} rows")
    return found


def micros(col: Column, kind: str = "timestamp_ntz") -> Column:
    """Microseconds since 1970-01-01 of a timestamp; a zone-less one is read as UTC whatever the session's zone is."""
    if kind == "timestamp":
        return F.unix_micros(col)
    day = F.datediff(col.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.date_part(F.lit("SECOND"), col) * 1_000_000).cast("long")
    return ((day * 24 + F.hour(col)) * 60 + F.minute(col)) * 60_000_000 + second


def micros_of(df: DataFrame, name: str) -> Column:
    return micros(F.col(name), dict(df.dtypes)[name])


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for steps that cost far more than a shuffle of a small input.

    Few or large row groups leave cores idle. An input with a partition for each core, as any large one has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
