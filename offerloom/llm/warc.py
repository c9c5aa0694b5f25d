"""WARC records and their fixity: Merkle trees over record hashes and ordered offset ranges.

Pages become WARC response records. Records are packed in order into archives of some
``ARCHIVE_BYTES`` bytes; each has an offset and a length in its archive. The leaf of a record is the
SHA-256 of its place and the digest of its bytes; an inner node hashes its ``FANOUT`` children and covers the range of
offsets from its first to its last record; the top node of an archive is its root.

An audit compares the roots of two replicas. Only below roots that differ it compares their children,
and so on down to the records: what agrees higher up is never looked at again. It reports every record
that is changed, missing or extra, with its offsets in both replicas.

Order and offsets come from one range partitioning by key and digest and a running sum over one row per
partition, so no task sees all records. A tree level is one pre-aggregated group-by over FANOUT children.

Defined results: null url or html count as empty; pages without id come first; repeated rows are
records of their own; an empty table has no archives. Records of one archive in two replicas are
matched by their position. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from offerloom.llm.common import ship
from offerloom.sources.tables import discard, stage

FANOUT = 16
ARCHIVE_BYTES = 1 << 24
DATE = "2000-01-01T00:00:00Z"
_HEAD = re.compile(rb"\AWARC/1\.[01]\r\n((?:[^\r\n]+\r\n)+)\r\n")


def record_of(url: Column, html: Column) -> Column:
    """A WARC response record, as bytes; its id and date are fixed by the content."""
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), html)
    digest = F.sha2(F.concat(url, F.lit("\n"), html).cast("binary"), 256)
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.regexp_replace(url, r"[\r\n]", " "),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:sha256:"),
        digest,
        F.lit(">\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def ordered_offsets(rows: DataFrame, keys: list[str], size: str) -> tuple[DataFrame, DataFrame]:
    """The rows with ``position`` and ``begin`` (rows and bytes before each) in the order of the keys.

    The rows are range-partitioned, sorted, counted in that order and staged in one stage, so they are
    shuffled once. What lies before a range is a running sum over one row per range. Rows that agree
    in all keys are told apart by a row number, so that no range has to hold all copies of one row.
    Also returns the staged table, for ``discard``.
    """
    spark = rows.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = rows.withColumn("__nr", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(n, *keys, "__nr").sortWithinPartitions(*keys, "__nr").drop("__nr")
    ranged = ranged.withColumn("__range", F.spark_partition_id())
    ship(spark)

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = total = 0
        for part in parts:
            sizes = part.column(size).to_numpy()
            upto = total + np.cumsum(sizes)
            columns = dict(zip(part.schema.names, part.columns))
            columns |= {"__i": pa.array(np.arange(seen, seen + part.num_rows)), "__b": pa.array(upto - sizes)}
            yield pa.RecordBatch.from_pydict(columns)
            seen, total = seen + part.num_rows, int(upto[-1]) if part.num_rows else total

    schema = StructType([*ranged.schema.fields, StructField("__i", LongType()), StructField("__b", LongType())])
    ranged = stage(ranged.mapInArrow(counted, schema), "ranges")
    sums = ranged.groupBy("__range").agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sums = stage(
        sums.select(
            "__range",
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__rows"),
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("__bytes"),
        ),
        "range-sums",
    )
    placed = ranged.join(F.broadcast(sums), "__range").select(  # one row per range
        *rows.columns,
        (F.col("__rows") + F.col("__i")).alias("position"),
        (F.col("__bytes") + F.col("__b")).alias("begin"),
    )
    return placed, ranged


def _archived(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    url, html = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("url", "html"))
    records = pages.select("page_id", record_of(url, html).alias("content")).withColumns(
        {"length": F.octet_length("content").cast("bigint"), "record_sha256": F.sha2("content", 256)}
    )
    placed, ranged = ordered_offsets(records, ["page_id", "record_sha256"], "length")
    placed = placed.withColumn("archive", F.floor(F.col("begin") / ARCHIVE_BYTES))
    starts = placed.groupBy("archive").agg(F.min("position").alias("p0"), F.min("begin").alias("b0"))
    records = placed.join(stage(starts, "archive-starts"), "archive").select(
        "page_id",
        "archive",
        (F.col("position") - F.col("p0")).alias("position"),
        (F.col("begin") - F.col("b0")).alias("offset"),
        "length",
        "record_sha256",
        "content",
    )
    return records, ranged


def archive(pages: DataFrame) -> DataFrame:
    """page_id, archive, position in it, offset, length, digest and content of every record, in key order."""
    return _archived(pages)[0]


def parse_record(content: bytes) -> tuple[str | None, bytes | None, bool]:
    """Target address, payload after the HTTP head, and whether the record is well formed."""
    head = _HEAD.match(content)
    if not head:
        return None, None, False
    fields = dict(line.split(b": ", 1) for line in head.group(1).split(b"\r\n") if b": " in line)
    try:
        length = int(fields.get(b"Content-Length", b"-1"))
    except ValueError:
        return None, None, False
    body = content[head.end() : head.end() + length] if length >= 0 else b""
    whole = length == len(body) and content[head.end() + length :] == b"\r\n\r\n"
    _, gap, payload = body.partition(b"\r\n\r\n")
    return fields.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), payload if gap else body, whole


def split_archive(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records of an uncompressed WARC file, by their lengths; a broken rest is one record."""
    at = 0
    while at < len(data):
        head = _HEAD.match(data[at : at + (1 << 16)])
        found = re.search(rb"\r\nContent-Length: (\d+)", head.group()) if head else None
        end = at + head.end() + int(found.group(1)) + 4 if found else len(data)
        yield at, data[at:end]
        at = end


def read_warc(spark, path: str) -> DataFrame:
    """Records of uncompressed WARC files: file, position, offset, length, content."""
    ship(spark)

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame.path, frame.content):
                found = [(file, i, at, len(x), x) for i, (at, x) in enumerate(split_archive(bytes(data)))]
                yield pd.DataFrame(found, columns=["archive", "position", "offset", "length", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(records, "archive string, position bigint, offset bigint, length bigint, content binary")


def leaves(records: DataFrame, digest: Column | None = None) -> DataFrame:
    """Level 0 of the trees: one node per record. Without a stated digest the content is hashed."""
    place = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"))
    content = F.sha2("content", 256) if digest is None else digest
    digest = F.sha2(F.concat_ws("\n", place, content), 256)
    return records.select(
        "archive",
        F.lit(0).alias("level"),
        F.col("position").alias("node"),
        "offset",
        (F.col("offset") + F.col("length")).alias("end"),
        digest.alias("hash"),
    )


def tree(records: DataFrame, digest: Column | None = None) -> DataFrame:
    """All nodes of all archives: archive, level, node, offset, end, hash. The top level has one node each."""
    level = stage(leaves(records, digest), "tree-level")
    levels = [level]
    most = level.agg(F.max("node")).first()[0]
    while most:
        level = level.groupBy("archive", (F.col("level") + 1).alias("level"), F.floor(F.col("node") / FANOUT).alias("node")).agg(
            F.min("offset").alias("offset"),
            F.max("end").alias("end"),
            F.sha2(
                F.array_join(
                    F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda c: c["hash"]), ","
                ),
                256,
            ).alias("hash"),
        )
        level = stage(level, "tree-level")
        levels.append(level)
        most //= FANOUT
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ between two trees: archive, position, state, offsets of both replicas."""
    top = max(x or 0 for x in (t.agg(F.max("level")).first()[0] for t in (primary, replica)))
    branch = None
    for level in range(top, -1, -1):
        left, right = (t.where(F.col("level") == level) for t in (primary, replica))
        if branch is not None:
            parent = F.floor(F.col("node") / FANOUT).alias("parent")
            left, right = (
                t.withColumn("parent", parent).join(branch, ["archive", "parent"], "left_semi").drop("parent")
                for t in (left, right)
            )
        both = left.alias("l").join(
            right.alias("r"),
            F.col("l.archive").eqNullSafe(F.col("r.archive")) & (F.col("l.node") == F.col("r.node")),
            "full",
        )
        differ = both.where(~F.col("l.hash").eqNullSafe(F.col("r.hash"))).select(
            F.coalesce("l.archive", "r.archive").alias("archive"),
            F.coalesce("l.node", "r.node").alias("node"),
            F.when(F.col("l.hash").isNull(), "extra").when(F.col("r.hash").isNull(), "missing").otherwise("changed").alias("state"),
            F.col("l.offset").alias("offset"),
            F.col("l.end").alias("end"),
            F.col("r.offset").alias("replica_offset"),
            F.col("r.end").alias("replica_end"),
        )
        differ = stage(differ, "mismatches")
        if differ.isEmpty():
            break
        branch = differ.select("archive", F.col("node").alias("parent"))
    return differ.withColumnRenamed("node", "position")


def fixity(pages: DataFrame) -> DataFrame:
    """Archive the pages, store a replica, read it back and audit it: one row per record.

    The primary keeps the digests taken when its records were made; the replica's stored bytes are
    hashed anew. ``state`` is intact, or what the audit found.
    """
    records, ranged = _archived(pages)
    replica = stage(records, "replica")
    own, other = tree(records, F.col("record_sha256")), tree(replica)
    discard(ranged)
    found = audit(own, other).select("archive", "position", "state")
    tops = own.groupBy("archive").agg(F.max_by("hash", F.struct("level", "node")).alias("root"))
    rows = replica.select("page_id", "archive", "position", "offset", "length", "record_sha256")
    return (
        rows.join(tops, "archive")
        .join(found, ["archive", "position"], "left")
        .withColumn("state", F.coalesce("state", F.lit("intact")))
        .select("page_id", "archive", "position", "offset", "length", "record_sha256", "root", "state")
    )
