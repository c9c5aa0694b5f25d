"""Suffix-array deduplication: bytes covered by a string of ``length`` bytes that also starts elsewhere.

Every string of ``length`` bytes has one anchor, the n-gram in it with the smallest hash (the leftmost
of equal ones). It depends on the string alone, so equal strings have their anchor at the same offset. The
strings of a text that share an anchor form a *context*: the bytes from the start of the first to the
end of the last. Contexts are counted by a 128-bit digest before anything else, so copies meet as one
row with a count. Where a context occurs twice, all its strings do.

Only anchors with different contexts need a closer look. Their contexts are compared by a suffix sort
from the anchor to the right and one of the reversed text to the left: prefix polynomial hashes and
binary search give the common extension of two suffixes, hence a comparison in logarithmic time, and a
mergesort of all anchors of a block at once does with such comparisons. Hashes only guide it: afterwards all
neighbours are compared byte by byte, and a block with a collision is sorted by its bytes. In sorted
order the contexts that agree on any stretch around the anchor are neighbours, so a string of
``length`` bytes occurs again if and only if another context falls into the same class on both sides.

An anchor with more than ``GROUP`` different contexts (a phrase in very many documents) is not held in
one task: the strings of its contexts are counted by their 128-bit digests, in a shuffle with partial sums.

Defined results: texts are their UTF-8 bytes, a null text is empty; no match crosses rows, but repeated
rows are rows of their own and match each other. Texts shorter than ``length`` lose nothing. Overlapping
occurrences count. All strings are judged on the input. Rows without id are treated as all others; further
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import ship, text_column
from offerloom.sources.tables import discard, stage

LENGTH = 200
GROUP = 4096
BLOCK = 16384
PIECE = 1 << 20
MOST_ROWS = 1 << 16
_PLACE = np.uint64((1 << 21) - 1)
_RANDOM = np.random.default_rng(20250115)
_BYTE = _RANDOM.integers(1, 1 << 63, 257, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
SPANS = "array<struct<begin:bigint,end:bigint>>"


def gram_size(length: int) -> int:
    """The largest power of two up to a quarter of the length, 32 at most."""
    return min(32, 1 << max(0, (length // 4).bit_length() - 1))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on; ``size`` is a power of two."""
    h, step = _BYTE[data], 1
    while step < size:
        h = h[:-step] * np.uint64(pow(int(_BASE), step, 1 << 64)) + h[step:]
        step *= 2
    return (h ^ (h >> np.uint64(29))) * _BASE


def sliding_least(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum of every ``window`` neighbours, from running minima of blocks in both directions."""
    count = len(keys) - window + 1
    padded = np.full(-(-len(keys) // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, window)
    onward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:count], onward[window - 1 : window - 1 + count])


def anchors(raw: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hash and place of each anchor, first and last start of its strings; one piece of the text at a time."""
    size = gram_size(length)
    window, starts = length - size + 1, len(raw) - length + 1
    for begin in range(0, starts, PIECE):
        end = min(begin + PIECE, starts)
        hashes = gram_hashes(np.frombuffer(raw, np.uint8, end - begin + length - 1, begin), size)
        keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        at = (sliding_least(keys, window) & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        last = np.append(first[1:], end - begin) - 1
        at = at[first]
        yield hashes[at].view(np.int64), begin + at, begin + first, begin + last


def _occurrences(length: int):
    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            held: list[tuple[np.ndarray, ...]] = []
            digests: list[bytes] = []
            for i, raw in enumerate(part.column("raw").to_pylist()):
                for hashes, at, first, last in anchors(raw, length):
                    ends = last + length
                    digests += [xxhash.xxh3_128_digest(raw[b:e]) for b, e in zip(first.tolist(), ends.tolist())]
                    held.append((np.full(len(at), i), hashes, first, at - first, ends - first))
                    if len(digests) >= MOST_ROWS:
                        yield batch(part, held, digests)
                        held, digests = [], []
            if held:
                yield batch(part, held, digests)

    def batch(part: pa.RecordBatch, held: list[tuple[np.ndarray, ...]], digests: list[bytes]) -> pa.RecordBatch:
        row, hashes, first, at, size = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_pydict(
            {
                "k1": part.column("k1").take(pa.array(row)),
                "k2": part.column("k2").take(pa.array(row)),
                "anchor": hashes,
                "digest": pa.array(digests, pa.binary()),
                "first": first,
                "at": at.astype(np.int32),
                "size": size.astype(np.int32),
            }
        )

    return found


OCCURRENCE = "k1 bigint, k2 bigint, anchor bigint, digest binary, first bigint, at int, size int"


class Side:
    """One side of the contexts of a block: bytes outward from the anchor and hashes of all their prefixes."""

    def __init__(self, buffer: np.ndarray, start: np.ndarray, size: np.ndarray, step: int):
        width = int(size.max(initial=0))
        offset = np.arange(width)
        inside = offset < size[:, None]
        place = np.where(inside, start[:, None] + step * offset, 0)
        self.size = size
        # 0 stands for the end, so that a text comes before its continuations
        self.bytes = np.where(inside, buffer[place].astype(np.int16) + 1, 0) if width else np.zeros((len(size), 0), np.int16)
        powers = np.multiply.accumulate(np.full(width, _BASE, np.uint64)) if width else np.zeros(0, np.uint64)
        self.hashes = np.zeros((len(size), width + 1), np.uint64)
        np.cumsum(_BYTE[self.bytes] * powers, axis=1, out=self.hashes[:, 1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of suffixes a[i] and b[i]: the longest prefixes with equal hashes, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b]).astype(np.int64)
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) // 2
            equal = self.hashes[a, middle] == self.hashes[b, middle]
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def after(self, a: np.ndarray, extension: np.ndarray) -> np.ndarray:
        """The byte that follows the extension, 0 at the end."""
        if not self.bytes.shape[1]:
            return np.zeros(len(a), np.int16)
        return np.where(extension < self.size[a], self.bytes[a, np.minimum(extension, self.bytes.shape[1] - 1)], 0)

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        extension = self.common(a, b)
        return self.after(a, extension) < self.after(b, extension)

    def merge_sorted(self, group: np.ndarray) -> np.ndarray:
        """Suffixes sorted within their groups (contiguous numbers): all merges of one width at a time."""
        count = len(group)
        order = np.arange(count)
        begin = np.searchsorted(group, group)
        end = np.searchsorted(group, group, side="right")
        inside, width = order - begin, 1
        while count and width < int((end - begin).max()):
            run = inside // width
            right = run % 2 == 1
            low = np.minimum(begin + (run + np.where(right, -1, 1)) * width, end)
            high = np.minimum(low + width, end)
            low0 = low.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                own, other = order[open_], order[middle]
                # equal suffixes: those of the left run first
                goes_on = np.where(right[open_], ~self.before(own, other), self.before(other, own))
                low[open_] = np.where(goes_on, middle + 1, low[open_])
                high[open_] = np.where(goes_on, high[open_], middle)
            first = begin + (run - right) * width
            place = first + inside % width + (low - low0)
            merged = np.empty_like(order)
            merged[place] = order
            order, width = merged, 2 * width
        return order

    def sorted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted suffixes and the common extension of each with the one before it, -1 at the start of a group."""
        order = self.merge_sorted(group)
        extension = self._verified(order, group)
        if extension is None:  # a collision of hashes: the bytes decide
            order = np.lexsort((*self.bytes.T[::-1], group)) if self.bytes.shape[1] else np.arange(len(group))
            extension = self._verified(order, group)
        return order, extension

    def _verified(self, order: np.ndarray, group: np.ndarray) -> np.ndarray | None:
        """Exact extensions of neighbours, or None if the order is not that of the bytes."""
        if len(order) < 2:
            return np.full(len(order), -1)
        a, b = order[:-1], order[1:]
        differ = self.bytes[a] != self.bytes[b]
        both = np.minimum(self.size[a], self.size[b])
        exact = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), both), both) if differ.shape[1] else both
        same = group[a] == group[b]
        if (same & (self.after(a, exact) > self.after(b, exact))).any():
            return None
        return np.concatenate([[-1], np.where(same, exact, -1)])


def repeated_starts(group: np.ndarray, raw: list[bytes], at: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """For each context (row) and offset of the anchor in a string (column): does the string occur again?

    Contexts are sorted by group; all of a group have the same anchor, ``at`` bytes from their begin.
    """
    size = np.array([len(x) for x in raw], np.int64)
    buffer = np.frombuffer(b"".join(raw), np.uint8)
    begin = np.cumsum(size) - size
    right, left = Side(buffer, begin + at, size - at, 1), Side(buffer, begin + at - 1, at, -1)
    (right_order, right_common), (left_order, left_common) = right.sorted(group), left.sorted(group)
    offsets = int(at.max(initial=0)) + 1
    again = np.zeros((len(raw), offsets), bool)
    right_class, left_class = np.empty(len(raw), np.int64), np.empty(len(raw), np.int64)
    for j in range(offsets):
        right_class[right_order] = np.cumsum(right_common < length - j)
        left_class[left_order] = np.cumsum(left_common < j)
        there = np.flatnonzero((at >= j) & (size - at >= length - j))
        _, class_ = np.unique(right_class[there] * (len(raw) + 1) + left_class[there], return_inverse=True)
        again[there, j] = np.bincount(class_, weights=count[there])[class_] >= 2
    return again


def _compared(length: int):
    """Contexts sorted by anchor to the stretches of repeated starts of those that occur once."""

    def stretches(rows: pa.Table) -> pa.RecordBatch:
        k1, k2, anchor, first, at, count = (rows.column(c).to_numpy() for c in ("k1", "k2", "anchor", "first", "at", "n"))
        group = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])])
        again = repeated_starts(group, rows.column("raw").to_pylist(), at.astype(np.int64), np.minimum(count, 2), length)
        again[count > 1] = False  # these are repeated as a whole
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        anchored = first[row] + at[row]
        return pa.RecordBatch.from_pydict(
            {"k1": k1[row], "k2": k2[row], "begin": anchored - (high - 1), "end": anchored - low + length}
        )

    def compared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([], _CONTEXT_ARROW)
        for part in parts:
            held = pa.concat_tables([held, pa.Table.from_batches([part]).cast(_CONTEXT_ARROW)])
            if held.num_rows >= BLOCK:
                anchor = held.column("anchor").to_numpy()
                new = np.flatnonzero(anchor[1:] != anchor[:-1])  # a group stays in one piece
                if len(new):
                    yield stretches(held.slice(0, int(new[-1]) + 1))
                    held = held.slice(int(new[-1]) + 1)
        if held.num_rows:
            yield stretches(held)

    return compared


def _strings(length: int):
    """Every string of every context with a digest of its bytes."""

    def strings(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for begin in range(0, part.num_rows, 256):
                rows = part.slice(begin, 256)
                raw = rows.column("raw").to_pylist()
                count = np.array([len(x) - length + 1 for x in raw])
                row = np.repeat(np.arange(len(raw)), count)
                start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                digests = [xxhash.xxh3_128_digest(raw[i][s : s + length]) for i, s in zip(row.tolist(), start.tolist())]
                columns = {c: rows.column(c).take(pa.array(row)) for c in ("k1", "k2", "n")}
                columns |= {"string": pa.array(digests, pa.binary()), "begin": rows.column("first").to_numpy()[row] + start}
                yield pa.RecordBatch.from_pydict({c: columns[c] for c in ("string", "k1", "k2", "begin", "n")})

    return strings


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted contexts of each text."""
    for part in parts:
        wanted = part.column("wanted")
        rows = pa.RecordBatch.from_struct_array(wanted.flatten())
        parent = pa.array(np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy())))
        texts = part.column("raw").to_pylist()
        places = zip(parent.to_pylist(), rows.column("first").to_pylist(), rows.column("size").to_pylist())
        columns = {c: rows.column(c) for c in ("anchor", "first", "at", "n", "m")}
        columns |= {c: part.column(c).take(parent) for c in ("k1", "k2")}
        columns["raw"] = pa.array([texts[i][b : b + size] for i, b, size in places], pa.binary())
        yield pa.RecordBatch.from_pydict({c: columns[c] for c in _CONTEXT_ARROW.names}, schema=_CONTEXT_ARROW)


CONTEXT = "k1 bigint, k2 bigint, anchor bigint, first bigint, at int, n bigint, m bigint, raw binary"
_WHOLE = {c: pa.int64() for c in ("k1", "k2", "anchor", "first")}
_CONTEXT_ARROW = pa.schema(_WHOLE | {"at": pa.int32(), "n": pa.int64(), "m": pa.int64(), "raw": pa.binary()})


def keyed_texts(documents: DataFrame) -> DataFrame:
    """doc_id, bytes, and two hashes of both that stand for the row; equal rows share them."""
    text = text_column()
    return documents.select(
        "doc_id",
        text.cast("binary").alias("raw"),
        F.xxhash64("doc_id", text).alias("k1"),
        F.xxhash64(text, F.lit("row"), F.col("doc_id")).alias("k2"),
    )


def repeated_strings(texts: DataFrame, length: int = LENGTH, group: int = GROUP) -> tuple[DataFrame, list[DataFrame]]:
    """(k1, k2, begin, end): stretches of texts whose strings of ``length`` bytes occur elsewhere; staged tables to discard."""
    spark = texts.sparkSession
    ship(spark)
    long_enough = texts.where(F.octet_length("raw") >= length)
    seen = stage(long_enough.select("k1", "k2", "raw").mapInArrow(_occurrences(length), OCCURRENCE), "occurrences")
    contexts = stage(
        seen.groupBy("anchor", "digest").agg(
            F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "at", "size")).alias("example")
        ),
        "contexts",
    )
    crowded = contexts.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    wanted = (
        contexts.join(crowded, "anchor")
        .select("example.*", "anchor", "n", "m")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("anchor", "first", "at", "size", "n", "m")).alias("wanted"))
    )
    one_each = long_enough.groupBy("k1", "k2").agg(F.first("raw").alias("raw"))
    cut = stage(one_each.join(wanted, ["k1", "k2"]).mapInArrow(_cut, CONTEXT), "context-bytes")
    compared = (
        cut.where(F.col("m") <= group)
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_compared(length), "k1 bigint, k2 bigint, begin bigint, end bigint")
    )
    strings = cut.where(F.col("m") > group).mapInArrow(
        _strings(length), "string binary, k1 bigint, k2 bigint, begin bigint, n bigint"
    )
    often = strings.groupBy("string").agg(F.sum("n").alias("n")).where("n > 1").select("string")
    counted = strings.where("n = 1").join(often, "string")
    counted = counted.select("k1", "k2", "begin", (F.col("begin") + length).alias("end"))
    copied = seen.join(contexts.where("n > 1").select("anchor", "digest"), ["anchor", "digest"])
    copied = copied.select("k1", "k2", F.col("first").alias("begin"), (F.col("first") + F.col("size")).alias("end"))
    return compared.unionByName(counted).unionByName(copied), [seen, contexts, cut]


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches joined where they touch or overlap."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
    return begin[new], reach[np.append(new[1:], len(begin)) - 1]


def _kept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        kept, spans = [], []
        for raw, found in zip(part.column("raw").to_pylist(), part.column("found").to_pylist()):
            if not found:
                kept.append(raw)
                spans.append([])
                continue
            begin, end = merged(*(np.array([s[k] for s in found], np.int64) for k in ("begin", "end")))
            joins = zip([0, *end.tolist()], [*begin.tolist(), len(raw)])
            kept.append(b"".join(raw[b:e] for b, e in joins))
            spans.append([{"begin": b, "end": e} for b, e in zip(begin.tolist(), end.tolist())])
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": part.column("doc_id"),
                "n_bytes": pa.array([len(x) for x in part.column("raw").to_pylist()], pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(kept, pa.binary()),
            }
        )


def without_repeats(documents: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, removed spans (byte offsets, maximal, in order) and the kept bytes of every row."""
    if length < 4:
        raise ValueError("strings of at least four bytes")
    texts = keyed_texts(documents)
    found, staged = repeated_strings(texts, length, group)
    spans = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    rows = texts.join(stage(spans, "spans"), ["k1", "k2"], "left").select("doc_id", "raw", "found")
    discard(*staged)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_kept, f"doc_id {kind}, n_bytes bigint, spans {SPANS}, kept binary")


def repeat_digests(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is kept."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["begin"])
    return without_repeats(documents, length).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
