"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "factweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and a UTC clock; `conf` overrides single settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    On a cluster this is the shared folder named by `spark.checkpoint.dir`. Only a local
    session without that setting gets a scratch folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        folder = named
    elif spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="spark-factweave-", dir="/tmp")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run's table, stream checkpoint or sink."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: removes the files of a query's shuffles when the query has ended
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What the shuffles of a write leave on the executors' disks goes as soon as it has ended, since
    nothing reads it again; otherwise it stays until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes a working table, whose shuffles then leave nothing behind."""
    with shuffles_removed(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_through(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(*tables: DataFrame) -> None:
    """Deletes tables that `write_through` returned, once what was made of them is written too."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
