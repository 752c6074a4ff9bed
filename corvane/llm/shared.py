"""Tables that outlive executors: written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where unset on one machine, as in tests, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def written(spark: SparkSession, df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.
    Deleted by ``dropped``, or else when the driver ends. ``few``: no more files than the cluster has cores,
    for tables of ids alone, whose files would be tiny."""
    if few:
        df = df.coalesce(max(1, spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._corvane_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Whole texts make large Arrow batches, which the JVM and Python both hold: fewer rows and bytes each
    than Spark's defaults, unless the session has set numbers of its own."""
    for key, usual, less in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", "8m")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, less)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def irregular(docs: DataFrame) -> bool:
    """Whether rows have no doc_id, or share one."""
    return bool(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").head(1))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
