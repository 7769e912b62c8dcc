"""File sources: JSON fixtures, JSON lines, provenance hashes, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fixture(spark: SparkSession, path: str, rows: str = "rows") -> DataFrame:
    """The records below one field of a JSON document."""
    return spark.read.json(path, multiLine=True).select(F.explode(rows).alias("r")).select("r.*")


def resource_trace(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of (name, memory, cpu) samples, with sizes in bytes and shares as numbers."""
    from ..functions.misc import bytes_of

    rows = spark.read.schema("name string, memory string, cpu string").json(path)
    return rows.select("name", bytes_of(F.col("memory")).alias("bytes"), F.regexp_extract("cpu", r"([0-9.]+)", 1).try_cast("double").alias("cpu_percent"))


def resource_peaks(trace: DataFrame) -> DataFrame:
    return trace.groupBy("name").agg(F.max("bytes").alias("peak_bytes"), F.avg("bytes").alias("mean_bytes"), F.max("cpu_percent").alias("peak_cpu"))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def synthetic_vectors(spark: SparkSession, n: int, dims: int) -> DataFrame:
    """(id, embedding): sin(n * i), for probes of an index."""
    return spark.range(1, n + 1).select("id", F.array(*[F.sin(F.col("id") * i) for i in range(1, dims + 1)]).alias("embedding"))


def relation_size(spark: SparkSession, path: str) -> int:
    """Bytes below a path; 0 if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0
