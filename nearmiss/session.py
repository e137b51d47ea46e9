"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot event in a join even where a later step then has to shuffle again
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # methods above 8,000 bytes are not compiled by the JVM; let Spark split them instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # folders are listed by at most this many tasks; one for each costs more than listing it
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
    # no Python stack trace per expression: plans here are built from many small expressions
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "nearmiss", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """The same settings on a session someone else built, wherever it leaves them open."""
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) is None and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach. A cluster names it in spark.checkpoint.dir; only a
    session that runs inside this one process may fall back to a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return os.path.join(tempfile.gettempdir(), f"nearmiss-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders of the tables that cut_lineage wrote, in order.
_written: list[str] = []


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back, so a lost executor costs one read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def tables_written(since: int = 0) -> list[str]:
    """Folders of the stored tables from the given number on; their number is where the next one stands."""
    return _written[since:]


def drop_tables(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Removes stored tables that nothing reads any more: everything made from them has been stored itself."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table if isinstance(table, str) else table._stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
