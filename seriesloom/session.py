"""Session settings shared by queries, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seriesloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master, where one machine is all there is, may go without the
    setting and gets a temporary folder; on a cluster its lack is an error,
    since a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isEmpty():
        return held.get()
    where = sc.getConf().get("spark.checkpoint.dir", "")
    if not where:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="seriesloom-")
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; for tables of few, small rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_once(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: columns compressed, and read only where needed.

    For wide or long intermediate tables that several branches read. The tables
    stay until the folder, which is the session's own, is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
