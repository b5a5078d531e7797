"""Session helpers: building one for local use, and the shared folder that cuts lineage."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "mnemospark", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with UTC, AQE and few shuffle partitions; for tests, the command line and the bench."""
    n = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where the setting is missing a temporary folder is taken, but only on a local master: on a cluster a
    machine-local folder would be lost with its machine, so that raises instead.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    jsc = spark.sparkContext._jsc.sc()
    if not folder and jsc.getCheckpointDir().isDefined():
        folder = jsc.getCheckpointDir().get()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="mnemospark-")
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, sized: bool = True) -> DataFrame:
    """``df`` written once to the shared folder: later jobs read it instead of computing it again.

    Spark keeps the size it guessed for ``df``, in which an array counts as one element. Without ``sized`` it forgets that
    guess, so that no join sends the rows through the driver before their real size is known.
    """
    spark = df.sparkSession
    shared_folder(spark)
    written = df.checkpoint(eager=True)
    if not sized:
        of = written._jdf
        written = DataFrame(spark._jsparkSession.internalCreateDataFrame(of.queryExecution().toRdd(), of.schema(), False), spark)
    del df
    gc.collect()  # with the references gone, the JVM's collector lets Spark drop the shuffle files behind the cut
    written.sparkSession.sparkContext._jvm.System.gc()
    return written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
