"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MORE_PARTITIONS, TASK_BYTES, TASK_ROWS = 5, "16m", 25_000


def local_session(cpus: int | str = "*", app: str = "stopwise") -> SparkSession:
    """Session for tests and the local benchmark; a cluster supplies its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.local.dir", scratch)
        .config("spark.checkpoint.dir", os.path.join(scratch, "shared"))
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings the plans rely on: AQE re-planning, also where it costs a shuffle, and small tasks.

    Shuffles start with several times the usual partitions, which AQE merges up to ``TASK_BYTES`` of shuffled
    bytes: rows take many times that in a task's memory, so this and not the input decides what a task holds.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions")) * MORE_PARTITIONS
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", TASK_BYTES)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder every executor can reach (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Shuffle files go when the write that needed them has ended, not when the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage where several branches of a plan use one result: the inputs behind it are
    read once, and a lost executor costs a re-read of the table, not a recomputation. What the write
    shuffled is dropped with its end, so a query's disk is that of its largest step and of the tables kept.
    """
    return materialize_all([df], name)


def materialize_all(frames: Iterable[DataFrame], name: str) -> DataFrame:
    """``materialize`` of frames of one schema, written one after the other to one table."""
    path = schema = None
    for df in frames:
        spark = df.sparkSession
        path, schema = path or shared_dir(spark, name), schema or df.schema
        before = spark.conf.get(DROP_SHUFFLES, "false")
        spark.conf.set(DROP_SHUFFLES, "true")
        try:
            df.write.mode("append").parquet(path)
        finally:
            spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for folder in {os.path.dirname(file) for file in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """A few rows of the driver as a frame.

    They go to the JVM as Arrow. A list would be copied by Python workers, which an executor keeps beside those of the queries.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(schema)
    columns = zip(*rows) if rows else [()] * len(fields)
    arrays = [pa.array(list(column), field.type) for column, field in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=fields), schema)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition an input that has fewer splits than the cluster has slots, or more than ``TASK_ROWS`` rows a split.

    Meant for work that costs far more per row than moving the row (parsing, tokenising), in time and in a
    task's memory. An input with enough splits is left as it is.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts, key)
