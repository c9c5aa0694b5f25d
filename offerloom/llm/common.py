"""What the corpus operators share: shipping the package, split of labels, bounded pre-filters."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BUCKETS = 1 << 18
TEXTS_AT_ONCE = 256
ROWS_PER_BATCH = 512
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix="offerloom-py-"), "offerloom_package"),
            "zip",
            os.path.dirname(package),
            os.path.basename(package),
        )
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        # texts can be long: a worker holds this many rows at a time
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_column(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """Every fifth checksum of the id is kept from training. A row without an id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def map_texts(
    df: DataFrame,
    function: Callable[[list[str]], Mapping[str, object]],
    added: str,
    at_once: int = TEXTS_AT_ONCE,
    at_end: Callable[[], None] = lambda: None,
) -> DataFrame:
    """Put columns computed from ``text`` in its place; all other columns pass by unread.

    ``function`` gets a few hundred texts at a time and returns the columns of the schema ``added``.
    Rows stay where they are: no shuffle, and a lost task is simply run again. ``at_end`` is called when a task
    ends, to let go of what ``function`` remembers: Spark keeps the worker, with all its memory, for later stages.
    """
    ship(df.sparkSession)
    rest = [f for f in df.schema.fields if f.name != "text"]
    new = StructType.fromDDL(added)
    kinds = to_arrow_schema(new)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for part in parts:
                for begin in range(0, part.num_rows, at_once):
                    rows = part.slice(begin, at_once)
                    made = function(rows.column("text").to_pylist())
                    columns = {f.name: rows.column(f.name) for f in rest}
                    columns |= {f.name: pa.array(made[f.name], f.type, from_pandas=False) for f in kinds}
                    yield pa.RecordBatch.from_pydict(columns)
        finally:
            at_end()

    return df.mapInArrow(batches, StructType([*rest, *new.fields]))


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def keep_buckets(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be among ``wanted`` (one column), before they are shuffled.

    What is broadcast are bucket numbers, of which there are at most ``BUCKETS`` at any input size.
    The filter lets too much through when ``wanted`` is very long, and never too little; an exact
    join has to follow.
    """
    found = wanted.select(bucket_of(F.col(wanted.columns[0])).alias("__bucket")).distinct()
    marked = rows.withColumn("__bucket", bucket_of(key))
    return marked.join(F.broadcast(found), "__bucket", "left_semi").drop("__bucket")


def with_row_key(rows: DataFrame) -> DataFrame:
    """Two hashes of (doc_id, text): rows that agree in both are copies of one row."""
    text = text_column()
    return rows.withColumns(
        {"__k1": F.xxhash64(F.col("doc_id"), text), "__k2": F.hash(text, F.col("doc_id"))}
    )


def drop_rows(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (with row keys) that are not among ``keys`` (columns __k1 and __k2).

    Most rows are let through by their bucket number and never move; only those that share a bucket
    with a key are joined. The broadcast holds ``BUCKETS`` numbers at most.
    """
    found = keys.select(bucket_of(F.col("__k1")).alias("__bucket")).distinct()
    marked = rows.withColumn("__bucket", bucket_of(F.col("__k1")))
    passed = marked.join(F.broadcast(found), "__bucket", "left_anti")
    unsure = marked.join(F.broadcast(found), "__bucket", "left_semi")
    kept = unsure.join(keys.select("__k1", "__k2").distinct(), ["__k1", "__k2"], "left_anti")
    return passed.unionByName(kept).drop("__bucket")
