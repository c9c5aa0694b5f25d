"""CSV files whose rows stand in a stated order: numbered files that make one table when put behind each other."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offerloom.sources.tables import remove_folder

LINE = ["_file", "_block", "_line"]


def with_line(df: DataFrame) -> DataFrame:
    """Rows of a file scan with their place: file, block in it, and a number that grows within the block."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def write_ordered(df: DataFrame, path: str, order: Sequence[str | Column], drop: Sequence[str] = ()) -> None:
    """Write rows in order, the header once, at the top of the first file; ``drop`` are columns that only order.

    Rows are range-partitioned by the order, and files are numbered by range. The folder appears under its name when
    all files are complete, so a reader sees the old files or the new ones, and a job that ends early leaves the old.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in set(drop)]
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"_k{i}") for i, o in enumerate(order)]
    lines = df.select(F.lit(1).alias("_body"), *keys, F.to_csv(F.struct(*kept)).alias("value"))
    head = spark.range(1).select(
        F.lit(0).alias("_body"),
        *[F.lit(None).cast(lines.schema[f"_k{i}"].dataType).alias(f"_k{i}") for i in range(len(keys))],
        F.lit(",".join(kept)).alias("value"),
    )
    names = ["_body", *[f"_k{i}" for i in range(len(keys))]]
    placed = head.unionByName(lines).repartitionByRange(*names).sortWithinPartitions(*names)
    new = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
    placed.select("value").write.text(new)
    remove_folder(spark, path)
    old, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (new, path))
    if not old.getFileSystem(spark._jsc.hadoopConfiguration()).rename(old, target):
        raise OSError(f"could not move {new} to {path}")


def read_ordered(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of :func:`write_ordered` with their place (``LINE``), in which order they were written."""
    header = ",".join(schema.names)
    lines = with_line(spark.read.text(path)).where(F.col("value") != header)
    parsed = F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), {"mode": "FAILFAST"})
    return lines.select(parsed.alias("row"), *LINE).select("row.*", *LINE)
