"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "emberday", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs in this package expect.

    Shuffle partition numbers are left to the cluster (adaptive execution
    coalesces and splits them); pass ``spark.sql.shuffle.partitions`` through
    ``conf`` for small local runs.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.timestampType", "TIMESTAMP_NTZ")
        # Methods above 8000 bytes of bytecode are never compiled by the JVM; past that,
        # operator-wise code, which is split into small methods, is several times faster.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Needed to read cp949 files; see sources.csv.
        .config("spark.sql.legacy.javaCharsets", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; on a local master without one, a new temporary one."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder is not None:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder all executors share")
    folder = tempfile.mkdtemp(prefix="emberday-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder, read back.

    Used where a frame feeds many jobs (iterative fits): it is computed once, later jobs
    read only the columns they need, and a lost executor re-reads files instead of
    recomputing the whole history of the frame.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/emberday/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.parquet(path)
    table._written_to = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete the folders of tables made by ``written`` that no later job reads."""
    for table in tables:
        spark, path = table.sparkSession, table._written_to
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
