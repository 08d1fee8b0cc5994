"""Session construction, table loading and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "larkspur", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and skew handling on; ``conf`` overrides (dots written as ``__``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # a call site per column call costs more than most plans here
    }
    base.update({k.replace("__", "."): v for k, v in conf.items()})
    for k, v in base.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory (a file or a directory of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and written tables.

    A cluster names it in ``spark.checkpoint.dir``. Only in local mode, where that is unset, is a
    folder of our own chosen; on a cluster a machine's own folder would be lost with the machine.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="larkspur-checkpoint-"))
        known = sc.getCheckpointDir()
    return known


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back, its lineage gone.

    The files outlive any executor, so an iterative plan neither grows nor restarts from its
    first round when an executor is lost.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, for results of many rows: compressed,
    read by column, and gone when the session ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """What tells this state of a table's files from another, within one application."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.sparkContext.applicationId, path, files.getContentSummary(at).getLength(), files.getFileStatus(at).getModificationTime()


def once(rows: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with repeated deliveries of a record counted once, without a shuffle of whole rows: only
    keys are counted, and only rows of keys that stand several times are compared with each other."""
    many = rows.groupBy(key).agg(F.count("*").alias("_times")).where("_times > 1").select(F.col(key).alias("_many"))
    repeated = F.col(key).eqNullSafe(F.col("_many"))
    return rows.join(many, repeated, "left_anti").unionByName(rows.join(many, repeated, "left_semi").distinct())
