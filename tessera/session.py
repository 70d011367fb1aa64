"""Session helper for tests, benchmarks and local use."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "tessera") -> SparkSession:
    """A local session; clusters bring their own and need none of this."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a scratch one only for a local master without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context._jsc.sc().getCheckpointDir().get()


def stage_folder(spark: SparkSession) -> str:
    """Folder of this application's stage tables in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def drop_stages(spark: SparkSession) -> None:
    """Delete this application's stage tables; results that still read them must be written first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="spark-")
    copy = shutil.copytree(os.path.join(root, "tessera"), os.path.join(folder, "src", "tessera"), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "tessera-package"), "zip", os.path.dirname(copy)))
    context._tessera_shipped = True


def materialise(df: DataFrame) -> DataFrame:
    """Action: write a stage table to the shared checkpoint folder and read it back.

    Used where a derived table feeds several branches: it is computed once, later
    scans prune its columns, and a lost executor costs a re-read, not the lineage.
    """
    folder = f"{stage_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(folder)
    return df.sparkSession.read.schema(schema).parquet(folder)
