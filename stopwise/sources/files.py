"""File sources and sinks. Schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopwise.session import materialize
from stopwise.sources import run_files as source


def _opens(path: str) -> bool:
    """Can Python workers open the path themselves? Other stores are left to Spark's own readers."""
    return "://" not in path or path.startswith("file:")


def run_files(spark: SparkSession, path: str, glob: str, **options) -> DataFrame:
    """Rows of the file source (see stopwise.sources.run_files)."""
    spark.dataSource.register(source.RunFiles)
    return spark.read.format("run_files").options(glob=glob, **options).load(path)


def write_run_files(df: DataFrame, path: str) -> str:
    """One file per row, in bundles: ``file`` is its name below ``path``, ``content`` its bytes."""
    df.sparkSession.dataSource.register(source.RunFiles)
    df.select("file", "content").write.format("run_files").mode("append").save(path)
    return path


def scan_traj_json(spark: SparkSession, path: str) -> DataFrame:
    """Run documents below ``path``, one whole file per row; the model is the first folder.

    A file that is no JSON, no text or can't be read keeps its row (``error`` says why, ``document`` is
    null), so that it ends in quarantine instead of failing the job.
    """
    if _opens(path):
        found = run_files(spark, path, "*.traj.json").select("file", "document", "error")
    else:
        base = path.rstrip("/") + "/"
        raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.traj.json").text(path, wholetext=True)
        found = raw.select(F.substring_index(F.col("_metadata.file_path"), base, -1).alias("file"), F.col("value").alias("document"), F.lit(None).cast("string").alias("error"))
    return found.select("file", F.substring_index("file", "/", 1).alias("model_dir"), "document", "error")


def scan_columns(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """Wanted columns that the files have, in wanted order; the rest is never decoded."""
    df = spark.read.parquet(path)
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have])


def scan_trials(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "trial_id string, trial_name string, task_name string, model string, agent string, reward int, steps string, row_key bigint"
    )
    return spark.read.schema(schema).parquet(path)


def scan_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Typed CSV read of a column subset; malformed rows fail the read."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.select(*columns) if columns else df


def scan_keyed_by_filename(spark: SparkSession, path: str, pattern: str, schema: str, key: str = "pair_id") -> DataFrame:
    """Union of CSV files whose path matches; the key is the pattern's first group."""
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .csv(path)
        .withColumn(key, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))
    )
    return df.where(F.col(key) != "")


def scan_folds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All folds of a table laid out as fold_tag=<tag>/; the tag is a partition column."""
    return spark.read.schema(schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> str:
    df.write.json(path)
    return path


def write_parquet(df: DataFrame, path: str, keys: Sequence[str] = (), max_records: int = 5_000_000) -> str:
    """Compressed Parquet, split into bounded files and, with ``keys``, into partition folders."""
    writer = df.write.option("compression", "zstd").option("maxRecordsPerFile", max_records)
    (writer.partitionBy(*keys) if keys else writer).parquet(path)
    return path


def nan_to_null(df: DataFrame) -> DataFrame:
    """Reports hold NULL where a number is undefined, never NaN."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numeric}) if numeric else df


def write_csv(df: DataFrame, path: str, single: bool = False) -> str:
    """CSV sink; ``single`` is for report tables of a few rows."""
    clean = nan_to_null(df)
    (clean.coalesce(1) if single else clean).write.option("header", True).csv(path)
    return path


def write_report_json(df: DataFrame, path: str, most_rows: int = 100_000) -> str:
    """JSON lines; one file when the report has at most ``most_rows`` rows, else as many as it has partitions."""
    clean = materialize(nan_to_null(df), "report")
    small = clean.limit(most_rows + 1).count() <= most_rows
    (clean.coalesce(1) if small else clean).write.option("ignoreNullFields", False).json(path)
    return path


def digest_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SHA-256 and size of every file under a root, however large: files are read in pieces.

    In stores that only Spark can open a file is one row, which Spark limits to 2 GB.
    """
    if _opens(path):
        return run_files(spark, path, glob, text=False).select("file", "bytes", "sha256")
    base = path.rstrip("/") + "/"
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    )
    return files.select(
        F.substring_index("path", base, -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )


def dataset_manifest(digests: DataFrame) -> DataFrame:
    """Files, bytes, empty files and misplaced files per model folder."""
    model = F.substring_index("file", "/", 1)
    parent = F.element_at(F.split("file", "/"), -2)
    name = F.regexp_extract("file", r"([^/]+)\.traj\.json$", 1)
    return digests.withColumns({"model": model, "misplaced": parent != name}).groupBy("model").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("bytes").alias("bytes"),
        F.count_if(F.col("bytes") == 0).alias("zero_byte_files"),
        F.count_if("misplaced").alias("misplaced_files"),
    )


def common_instances(rows: DataFrame, model: str = "model_id", instance: str = "instance_id") -> DataFrame:
    """Instances that all models have, and the union of instances."""
    seen = rows.select(model, instance).distinct()
    per_instance = seen.groupBy(instance).agg(F.count(F.lit(1)).alias("models"))
    n_models = seen.select(F.count_distinct(model)).scalar()
    return per_instance.agg(
        F.count(F.lit(1)).alias("union_instances"), F.count_if(F.col("models") == n_models).alias("common_instances")
    )


def shard_profile(spark: SparkSession, path: str) -> DataFrame:
    """Rows per file, from row counts alone, and the number of columns."""
    df = spark.read.parquet(path)
    return (
        df.groupBy(F.col("_metadata.file_name").alias("file"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("columns", F.lit(len(df.columns)))
    )
