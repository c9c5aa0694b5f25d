"""Readers, writers and staged tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from offerloom.session import shared_folder

T = TypeVar("T")

#: Rows that one task reads or counts at most, wherever a step keeps something for each row.
ROWS_PER_TASK = 500_000


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Comma-separated text with a header row, read with a declared schema.

    A malformed value stops the read instead of turning into a silent NULL.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", ",")
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write with a header and no index; ``single_file`` is for small reports only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The stage cuts the lineage, so a lost executor never recomputes what lies
    before it. It also gives the optimiser the true size of the table: a small
    lookup is then broadcast without shuffling the other side, and one above
    ``spark.sql.autoBroadcastJoinThreshold`` is joined by shuffle.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/stages/{app}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def session_beside(spark: SparkSession, settings: Mapping[str, str]) -> SparkSession:
    """A session with the settings of this one, but for those given."""
    beside = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if beside.conf.isModifiable(key):
            beside.conf.set(key, value)
    for key, value in settings.items():
        beside.conf.set(key, value)
    return beside


def stage_for_fits(df: DataFrame, name: str, partition_by: Sequence[str] = (), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Stage ``df`` and read it back in tasks of about ``rows_per_task`` rows at most.

    A fit holds every row of a task in memory, several times as large as in the file, and goes through them once per level of each
    tree. A split by bytes would put ever more rows into one task. Nothing is shuffled: no file is longer than a
    task, and a table that is too long for one task per core is read by a session of its own with a smaller split size.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/stages/{app}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_task).partitionBy(*partition_by).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    n = staged.count()
    if n <= rows_per_task * spark.sparkContext.defaultParallelism:
        return staged
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    reader = session_beside(spark, {"spark.sql.files.maxPartitionBytes": str(max(1, size * rows_per_task // n))})
    return reader.read.schema(df.schema).parquet(path).select(*df.columns)


def deal_long(df: DataFrame, n_rows: int, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` dealt out by ``keys`` in tasks of about ``rows_per_task`` rows, if it is too long for one such task per core.

    It goes before a step that keeps all groups of a task in memory. Shuffle partitions do not follow the input, and
    narrow rows are merged by bytes into ever longer tasks; this number of tasks follows the rows.
    """
    if n_rows <= rows_per_task * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(-(-n_rows // rows_per_task), *keys)


def discard(*staged: DataFrame) -> None:
    """Remove staged tables that no later step reads; anything but a staged table is left alone."""
    for df in staged:
        files = df.inputFiles()
        if files and "/stages/" in files[0]:
            remove_folder(df.sparkSession, files[0].rsplit("/", 1)[0])


def discard_all(spark: SparkSession) -> None:
    """Remove everything that this application has staged."""
    remove_folder(spark, f"{shared_folder(spark)}/stages/{spark.sparkContext.applicationId}")


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, with all that is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_written(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written there to its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], T]], parallelism: int) -> list[T]:
    """Run functions that start Spark jobs, ``parallelism`` at a time; results come in order."""
    in_session = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        running = [pool.submit(in_session(job)) for job in jobs]
        return [job.result() for job in running]


def stage_all(spark: SparkSession, tables: Mapping[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Stage tables that do not depend on each other; their jobs run side by side."""
    jobs = [lambda name=name, make=make: stage(make(), name) for name, make in tables.items()]
    return dict(zip(tables, side_by_side(spark, jobs, len(jobs))))


def stage_bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """Stage ``df`` in files that each hold one hash bucket of ``key``, sorted by it.

    Tables staged with the same key and number of buckets (default: ``spark.sql.shuffle.partitions``) are joined, and
    counted by the key, where they lie: no shuffle. The rows are dealt out by the key once, so that there is one file per
    bucket. A key that holds very many rows makes one large bucket; use :func:`stage` for such a table.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    app = spark.sparkContext.applicationId
    unique = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/stages/{app}/{unique}"
    dealt = df.repartition(buckets, key)
    dealt.write.option("path", path).format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(unique)
    return spark.table(unique).select(*df.columns)
