"""Writers: tables in two formats, idempotent replacement by key, manifests, and a ledger of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nested_to_json(df: DataFrame) -> DataFrame:
    """Structs, maps and arrays as JSON text, other columns as they are."""
    return df.select(*[F.to_json(c).alias(c) if kind.startswith(("struct", "map", "array")) else F.col(c) for c, kind in df.dtypes])


def export(df: DataFrame, folder: str, name: str) -> None:
    """``name`` as Parquet (zstd) and as gzipped CSV with a header, nested columns as JSON text in both."""
    flat = nested_to_json(df)
    flat.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/parquet/{name}")
    flat.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{folder}/csv/{name}")


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write ``df`` so that only the partitions (by ``by``) it holds are replaced; running it twice changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_new(df: DataFrame, path: str, key: str, spark: SparkSession) -> int:
    """Append the rows whose ``key`` the table at ``path`` lacks (the first of repeats); returns their number."""
    fresh = df.dropDuplicates([key])
    try:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    count = fresh.count()
    if count:
        fresh.write.mode("append").parquet(path)
    return count


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every data file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def log_run(spark: SparkSession, path: str, run_id: str, status: str, note: str = "") -> None:
    """Append one status row of a run to the ledger."""
    spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(status).alias("status"), F.lit(note).alias("note"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def run_states(spark: SparkSession, path: str) -> DataFrame:
    """The last status of each run."""
    return spark.read.parquet(path).groupBy("run_id").agg(F.max(F.struct("at", "status", "note")).alias("s")).select("run_id", "s.status", "s.note", "s.at")
