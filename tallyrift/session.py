"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
UNION_KEY = "spark.sql.unionOutputPartitioning"


def build_session(app_name: str = "tallyrift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on. Partition counts are left
    to the cluster; adaptive execution coalesces and splits them at run time."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return plain_unions(builder.getOrCreate())


def plain_unions(spark: SparkSession) -> SparkSession:
    """Unions keep their inputs apart. Pairing up the partitions of equally
    partitioned inputs fails when adaptive execution changes one of them."""
    spark.conf.set(UNION_KEY, "false")
    return spark


RUN = uuid.uuid4().hex  # one folder of intermediate tables per process
LEFT: set[str] = set()  # folders that go when the driver ends


def shared_folder(spark: SparkSession) -> str:
    """This run's folder, which all executors can read and write: below
    ``spark.checkpoint.dir``, or below the warehouse where that is not set and either lies on a
    shared file system or the master is local. Elsewhere every executor would write to a disk
    of its own, so that ends the job."""
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        master, scheme = spark.sparkContext.master, folder.partition(":")[0] if ":" in folder else "file"
        if scheme == "file" and master != "local" and not master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    return f"{folder.rstrip('/')}/tallyrift-{RUN}"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def release(spark: SparkSession) -> None:
    """Remove this run's intermediate tables. Results that were not written elsewhere
    cannot be read any more. What is left then goes when the driver ends."""
    path, files = _files(spark, shared_folder(spark))
    files.delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What follows has a short lineage, survives lost executors, and reads only
    the columns it needs. Row counts of the result come from Parquet footers."""
    spark = plain_unions(df.sparkSession)
    folder = shared_folder(spark)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if folder not in LEFT:
        LEFT.add(folder)
        run, files = _files(spark, folder)
        files.deleteOnExit(run)
    return spark.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, columns: dict[str, list], types: dict[str, pa.DataType]) -> DataFrame:
    """A few rows the driver already holds, as a local relation: the planner knows
    their size and reads them without a job."""
    arrays = {name: pa.array(columns[name], kind) for name, kind in types.items()}
    return spark.createDataFrame(pa.table(arrays))
