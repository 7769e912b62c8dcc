"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch: texts may be very long, so a batch of them must stay small.
ARROW_ROWS = 512
#: Whether the files of an execution's shuffles go when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: dict[str, str] = {}
_shipped: set[str] = set()
_written: dict[str, list[str]] = {}


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, and send this package to the executors once in an application."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="ship-")
    path = os.path.join(folder, f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _shipped.add(app)


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset in local mode, as in tests, one is made on this
    machine; elsewhere that would be a folder that the others can't see, and is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, _own_dir[app], ignore_errors=True)
    return "file://" + _own_dir[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks it ran, not what led to this table.  What the write shuffled is
    of no more use once the table is there, so its files go at once and not at some garbage collection of the driver.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``materialise`` wrote; call it when no result that reads them is needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def append_columns(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]], fields: list[T.StructField]
) -> DataFrame:
    """Add ``fields`` to the rows of ``df``, computed from Arrow batches.

    ``make`` runs once in each task and returns the function of a batch.  A column of ``df`` that has the name of an
    added one gives way to it.
    """
    prepare(df.sparkSession)
    names = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in names]
    df = df.select(*[col(f.name) for f in kept])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                new = f(batch)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(new[n] for n in names)], names=[*batch.schema.names, *names]
                )

    return df.mapInArrow(run, T.StructType([*kept, *fields]))


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The texts of a batch as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % F.lit(n)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one that lies in fewer splits than there are cores is dealt out first, as a small file is one task's work."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
