"""Session helpers shared by every subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weftlink")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows of an Arrow batch: whole texts are long, and a batch is held twice, in the JVM and in Python.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver has it on its path, and keeps batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)
    return spark


def application() -> str:
    """The id of the running application; functions made for one are of no use to the next."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return spark.sparkContext.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a temporary one only for a local master.

    Raises if a cluster names no folder: a machine-local one would be lost with
    its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftlink-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that is free, in a shared folder of this application that goes when its driver ends."""
    root = f"{shared_dir(spark).rstrip('/')}/weftlink-{spark.sparkContext.applicationId}"
    where, fs = _files(spark, root)
    if not fs.exists(where):
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        where, fs = _files(spark, path)
        fs.delete(where, True)


#: Bytes of a row group of written tables; a writer holds one in memory.
ROW_GROUP = 16 << 20


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again, which cuts its lineage.

    Columns stay columns, so a reader takes only those it needs; a lost executor costs
    nothing that was written.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "table")
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


checkpointed = written
