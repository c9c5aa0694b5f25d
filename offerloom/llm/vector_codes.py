"""Product codes for vectors: every part gets the index of its nearest codebook entry, exactly.

The space of a part is cut into grid cells with sides of ``CELL``. For a cell, the smallest distance of
its box to an entry and the largest one bound the distance of any part inside. An entry whose smallest
distance exceeds another one's largest is dominated and never the nearest. Each task keeps the entries that
are left, by the bytes of (part, cell), and measures only those; the rest of the codebook is not looked at.
Entries that could tie are never dominated, so ties go to the smaller index as in a full search.
The memo of a task holds ``MEMO`` cells at most and is then begun anew; it decides what is computed twice,
never a result. Codebooks (parts x entries) are all that travels between driver and tasks; each round
sends sums and counts per entry and task, which Spark adds up.

Defined results: components become floor(256 * x), kept within 64 bits. Vectors that are null, or hold a
null, NaN or infinite component, are dropped; rows without id are kept and come last among the ids, equal
ids in order of their vectors, and repeated rows are rows of their own. Vectors are cut into ``parts``
equal parts; a shorter vector, and one whose length is no multiple, is filled up with zeros to the
longest. With fewer kept rows than entries the codebooks are shorter. An error beyond the largest long is
given as the largest long. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import ship
from offerloom.sources.tables import stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
CELL = 32
MEMO = 1 << 17
EXACT = 1 << 61
LARGEST = (1 << 63) - 1
ROWS = 4096


def whole_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a usable vector, with its whole-number components as ``x``."""
    e, infinite = F.col(vector), F.lit(float("inf"))
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == infinite))
    x: Column = F.transform(vector, lambda v: F.floor(F.lit(256.0) * v.cast("double")))
    return vectors.where(e.isNotNull() & ~F.coalesce(bad, F.lit(True))).withColumn("x", x)


def parts_of(rows: pa.Array, parts: int, width: int) -> np.ndarray:
    """Vectors (rows x parts x width) from lists of whole numbers, filled up with zeros."""
    sizes = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy()
    out = np.zeros((len(rows), parts * width), np.int64)
    inside = np.arange(parts * width) < sizes[:, None]
    out[inside] = flat
    return out.reshape(len(rows), parts, width)


def undominated(low: np.ndarray, book: np.ndarray, cell: int = CELL) -> np.ndarray:
    """For each box (row; smallest corner), which entries may be nearest to a point in it."""
    below, above = low[:, None, :] - book, book - (low[:, None, :] + cell - 1)
    nearest = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
    farthest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
    return nearest <= farthest.min(axis=1)[:, None]


class Grid:
    """Nearest entries of one set of codebooks (parts x entries x width), with the memo of a task."""

    def __init__(self, books: np.ndarray, cell: int = CELL, memo: int = MEMO):
        self.books, self.cell, self.most = books, cell, memo
        self.memo: dict[bytes, np.ndarray] = {}
        self.largest = int(np.abs(books.astype(object)).max(initial=0))
        self.measured = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance to it, for each row and part of ``x``."""
        reach = self.largest + int(np.abs(x.astype(float)).max(initial=0)) + 2 * self.cell
        if reach * reach * max(1, x.shape[2]) >= EXACT:
            return self._nearest_large(x)
        made = [self._nearest_in_part(x[:, part, :], part) for part in range(x.shape[1])]
        return np.stack([m[0] for m in made], axis=1), np.stack([m[1] for m in made], axis=1)

    def _candidates(self, cells: np.ndarray, part: int) -> list[np.ndarray]:
        keys = [part.to_bytes(2, "little") + c.tobytes() for c in cells]
        new = [i for i, key in enumerate(keys) if key not in self.memo]
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = list(range(len(keys)))
        for begin in range(0, len(new), 1024):
            some = new[begin : begin + 1024]
            kept = undominated(cells[some] * self.cell, self.books[part], self.cell)
            for i, row in zip(some, kept):
                self.memo[keys[i]] = np.flatnonzero(row)
        return [self.memo[key] for key in keys]

    def _nearest_in_part(self, x: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        cells = x // self.cell
        order = np.lexsort(cells.T) if cells.shape[1] else np.arange(len(x))
        moved = (cells[order][1:] != cells[order][:-1]).any(axis=1)
        first = np.flatnonzero(np.concatenate([[True], moved]))
        found = self._candidates(cells[order][first], part)
        many = np.repeat([len(f) for f in found], np.diff(np.append(first, len(x))))
        row = np.repeat(order, many)
        rows_of = np.diff(np.append(first, len(x)))
        entry = np.concatenate([np.tile(f, n) for f, n in zip(found, rows_of.tolist())])
        self.measured += len(entry)
        gap = ((x[row] - self.books[part][entry]) ** 2).sum(axis=1)
        begin = np.cumsum(many) - many
        least = np.minimum.reduceat(gap, begin)
        at = np.flatnonzero(gap == np.repeat(least, many))
        at = at[np.searchsorted(at, begin)]  # the first of the nearest: entries are in order
        index, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        index[order], distance[order] = entry[at], least
        return index, distance

    def _nearest_large(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Components so large that squares leave 64 bits: Python's whole numbers, all entries."""
        index, distance = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], object)
        books = self.books.astype(object)
        for r, p in np.ndindex(*x.shape[:2]):
            gaps = ((books[p] - x[r, p].astype(object)) ** 2).sum(axis=1).tolist()
            distance[r, p] = min(gaps)
            index[r, p] = gaps.index(distance[r, p])
        return index, distance


def _sums(books: np.ndarray, parts: int, width: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Grid(books)
        total, count = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                x = parts_of(batch.column("x").slice(begin, ROWS), parts, width)
                index, _ = grid.nearest(x)
                fits = int(np.abs(x.astype(float)).max(initial=0)) * len(x) < EXACT
                for p in range(parts):
                    part_sum = np.zeros(books.shape[1:], np.int64 if fits else object)
                    np.add.at(part_sum, index[:, p], x[:, p] if fits else x[:, p].astype(object))
                    total[p] += part_sum
                    count[p] += np.bincount(index[:, p], minlength=books.shape[1])
        p, e = np.nonzero(count)
        values = [[Decimal(int(v)) for v in total[i, j]] for i, j in zip(p, e)]
        yield pa.RecordBatch.from_pydict(
            {
                "part": p.astype(np.int32),
                "entry": e.astype(np.int32),
                "n": count[p, e],
                "total": pa.array(values, pa.list_(pa.decimal128(38, 0))),
            }
        )

    return sums


def _codes(books: np.ndarray, parts: int, width: int):
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Grid(books)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                rows = batch.slice(begin, ROWS)
                index, distance = grid.nearest(parts_of(rows.column("x"), parts, width))
                columns = {c: rows.column(c) for c in rows.schema.names if c != "x"}
                columns["code"] = [row.tobytes().hex() for row in index.astype(np.uint8)]
                error = [min(int(d), LARGEST) for d in distance.astype(object).sum(axis=1)]
                yield pa.RecordBatch.from_pydict(columns | {"error": pa.array(error, pa.int64())})

    return codes


def fit_codebooks(rows: DataFrame, first: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (parts x entries x width) after ``rounds`` of Lloyd's method, in whole numbers.

    ``rows`` hold x, ``first`` the rows that the codebooks begin with (``entries`` at most).
    """
    longest = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    width = -(-longest // parts)
    begin = [r["x"] for r in first.collect()]
    books = parts_of(pa.array(begin, pa.list_(pa.int64())), parts, width).transpose(1, 0, 2)
    made = "part int, entry int, n bigint, total array<decimal(38,0)>"
    for _ in range(rounds if len(begin) else 0):
        sums = rows.select("x").mapInArrow(_sums(books, parts, width), made)
        each = sums.select("part", "entry", "n", F.posexplode("total").alias("place", "value"))
        means = each.groupBy("part", "entry", "place").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
        books = books.copy()
        for r in means.collect():  # one row per entry and component
            books[r["part"], r["entry"], r["place"]] = int(r["value"]) // r["n"]
    return books


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def encode_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    keep: tuple[str, ...] = ("label",),
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """Id, the columns ``keep``, code and error of every usable vector; and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hexadecimal digits: 1 to 256 entries")
    ship(vectors.sparkSession)
    rows = whole_vectors(vectors.select(id_column, vector, *keep), vector).select(id_column, *keep, "x")
    first = rows.orderBy(F.asc_nulls_last(id_column), "x").limit(entries)
    books = fit_codebooks(rows, first, parts, entries, rounds)
    width = books.shape[2]
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_column, *keep)) + ", code string, error bigint"
    return rows.mapInArrow(_codes(books, parts, width), schema), books


def code_report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, error of all vectors with the same label, and the digest of the codebooks."""
    codes, books = encode_vectors(vectors)
    codes = stage(codes, "codes")
    label_error = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)"))
    labels = codes.groupBy(F.col("label").alias("__label")).agg(label_error.cast("bigint").alias("label_error"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return codes.join(labels, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
