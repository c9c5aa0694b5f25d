"""Work that depends on a global order, done without a global sort in one task.

Rows are range-partitioned by the order and written once together with the number
of the range they fell in. Each range is then worked on alone, and what has to pass
from one range to the next (a running total, a last value) is a table with one row
per range: never more than ``spark.sql.shuffle.partitions`` rows, whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from offerloom.functions.hashing import HASH_RANGE
from offerloom.sources.tables import discard, stage

RANGE = "_range"


def into_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Stage ``df`` in ordered ranges, numbered in ``_range``.

    The number is written down with the row, so a task that runs again cannot
    come to other range bounds than its neighbours.
    """
    return stage(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def running_totals(
    df: DataFrame, order: str, values: Sequence[str], groups: Sequence[str] = ()
) -> DataFrame:
    """Add ``<value>_before``, the total over all smaller rows of the same group, and ``<value>_total``.

    (groups, order) must be unique; count equal rows together first.
    """
    ranged = into_ranges(df, [*groups, order])
    parts = [RANGE, *groups]
    sums = ranged.groupBy(*parts).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])

    across = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = across.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *parts,
        *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_offset_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(across).alias(f"{v}_total") for v in values],
    )
    within = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.sum(v).over(within).alias(f"_local_{v}") for v in values])
    # null-safe: a NULL group is a group
    renamed = offsets.withColumnsRenamed({p: f"_part_{p}" for p in parts})
    same = [F.col(p).eqNullSafe(F.col(f"_part_{p}")) for p in parts]
    joined = local.join(renamed, same)
    return joined.select(
        *df.columns,
        *[(F.coalesce(f"_local_{v}", F.lit(0)) + F.col(f"_offset_{v}")).alias(f"{v}_before") for v in values],
        *[f"{v}_total" for v in values],
    )


def rank_by_hash(df: DataFrame, hash_column: str, tie_break: str, groups: Sequence[str] = ()) -> DataFrame:
    """Add ``position`` (from 0) in the order of a uniform hash, and ``n_rows``, per group.

    A hash is spread evenly, so equal slices of its span are ranges of equal size
    and need neither sampling nor staging. There are four slices per shuffle
    partition, so slices shrink as the session is set up for more data.
    """
    ranges = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.withColumn(RANGE, F.floor(F.col(hash_column) * ranges / HASH_RANGE).cast("int"))
    parts = [*groups, RANGE]
    counts = sliced.groupBy(*parts).agg(F.count("*").alias("_n"))
    across = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = across.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_o_{c}") for c in parts],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(across).alias("n_rows"),
    )
    within = Window.partitionBy(*parts).orderBy(hash_column, tie_break)
    local = sliced.withColumn("_local", F.row_number().over(within) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in parts]
    return local.join(offsets, same).select(
        *df.columns, (F.col("_local") + F.col("_offset")).alias("position"), "n_rows"
    )


def forward_fill(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Replace NULL by the last value before it in the order of ``key`` (unique, not NULL)."""
    ranged = into_ranges(df, [key])
    ends = ranged.groupBy(RANGE).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(key))).alias(f"_end_{c}") for c in columns]
    )
    earlier = Window.partitionBy(F.lit(0)).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        RANGE, *[F.last(f"_end_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in columns]
    )
    so_far = Window.partitionBy(RANGE).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})
    # At most one row per range, so this broadcast is bounded by the partition setting.
    joined = local.join(F.broadcast(carried), RANGE, "left")
    filled = {c: F.coalesce(c, f"_carry_{c}") for c in columns}
    return joined.withColumns(filled).select(*df.columns)


#: Items of a sketch per level; a rank read from it is off by some 0.13 % of the rows, rarely by more.
SKETCH = 4096
RANK_ERROR = 2.296 / SKETCH**0.9021
#: Values strictly inside a bracket that one row may hold.
BRACKET = 1 << 16


class _Slot:
    """One quantile of one column: two values that close in on the neighbouring ranks it lies between."""

    def __init__(self, column: str, p: float, n: int, numbers: int, ends: Sequence[float]):
        place = (n - 1) * p
        self.column, self.numbers = column, numbers
        self.ranks, self.part = (math.floor(place), math.ceil(place)), place - math.floor(place)
        (self.low, self.high), self.expected = ends, 8 * RANK_ERROR * numbers
        self.values: list[float | None] = [None if r < numbers else math.nan for r in self.ranks]  # NaN is above all

    def wanted(self) -> list[int]:
        return [r for r, known in zip(self.ranks, self.values) if known is None]

    def sketched(self) -> bool:
        """Whether too many rows are expected between the ends to tell their values apart now."""
        return self.expected > BRACKET

    def begin_anew(self) -> None:
        self.low, self.high, self.expected = -math.inf, math.inf, self.numbers

    def learn(self, known: Mapping[tuple[str, int], float]) -> None:
        self.values = [known.get((self.column, r)) if v is None else v for r, v in zip(self.ranks, self.values)]

    def result(self) -> float:
        (low, high), part = self.values, self.part
        if part == 0 or low == high:
            return low
        return low + (high - low) * part if part < 0.5 else high - (high - low) * (1 - part)


def _counted_ends(numeric: DataFrame, slots: Sequence[_Slot]) -> dict[str, list[tuple[float, int, int]]]:
    """One pass: each end of a bracket with the rows before it and on it, in order, by column."""
    ends = {c: sorted({e for s in slots if s.column == c for e in (s.low, s.high)}) for c in {s.column for s in slots}}
    counts = []
    for c, found in ends.items():
        for i, e in enumerate(found):
            counts += [F.count_if(F.col(c) < e).alias(f"{c}|{i}<"), F.count_if(F.col(c) == e).alias(f"{c}|{i}=")]
    row = numeric.agg(*counts).first()
    return {c: [(e, row[f"{c}|{i}<"], row[f"{c}|{i}="]) for i, e in enumerate(found)] for c, found in ends.items()}


def _values_between(numeric: DataFrame, gaps: Mapping[tuple[str, float, float, int], set[int]]) -> dict[tuple[str, int], float]:
    """The values at some ranks. A gap is (column, low, high, rows up to low); its values lie strictly inside.

    All other rows are dropped where they are read, and equal values are counted together before they are sorted.
    """
    inside, asked, columns = {}, F.lit(False), sorted({g[0] for g in gaps})
    for i, ((c, low, high, before), ranks) in enumerate(gaps.items()):
        inside.setdefault(c, []).append((i, (F.col(c) > low) & (F.col(c) < high)))
        for r in ranks:
            asked = asked | ((F.col("gap") == i) & F.lit(r - before).between(F.col("ahead"), F.col("ahead") + F.col("n") - 1))
    held = {c: reduce(Column.__or__, [test for _, test in found]) for c, found in inside.items()}
    some = numeric.where(reduce(Column.__or__, held.values())).select(*[F.when(held[c], F.col(c)).alias(c) for c in columns])
    numbers = F.coalesce(*[F.when((F.col("c") == g[0]) & (F.col("v") > g[1]) & (F.col("v") < g[2]), i) for i, g in enumerate(gaps)])
    long = some.unpivot([], columns, "c", "v").where(F.col("v").isNotNull()).select(numbers.alias("gap"), "v")
    counts = long.groupBy("gap", "v").agg(F.count("*").alias("n"))
    smaller = Window.partitionBy("gap").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)  # some BRACKET values
    ranked = counts.withColumn("ahead", F.coalesce(F.sum("n").over(smaller), F.lit(0))).where(asked)
    found, keys = {}, list(gaps)
    for row in ranked.collect():  # one row per rank
        gap = keys[row["gap"]]
        found |= {(gap[0], r): row["v"] for r in gaps[gap] if row["ahead"] <= r - gap[3] < row["ahead"] + row["n"]}
    return found


def _close_in(numeric: DataFrame, slots: Sequence[_Slot]) -> None:
    """Count at the ends of all brackets; settle what can be settled, and narrow the brackets of the rest."""
    ends = _counted_ends(numeric, slots)
    known = {
        (s.column, r): e for s in slots for r in s.wanted() for e, before, n in ends[s.column] if before <= r < before + n
    }
    gaps: dict[tuple[str, float, float, int], set[int]] = {}
    narrow: list[tuple[_Slot, int, int]] = []
    for slot in slots:
        slot.learn(known)
        upto, below = ({e: v for e, *v in ends[slot.column]}[end] for end in (slot.low, slot.high))
        first, after = sum(upto), below[0]
        if not slot.wanted():
            continue
        if not first <= slot.wanted()[0] <= slot.wanted()[-1] < after:
            slot.begin_anew()  # missed: the sketch was too far off
        elif slot.sketched():
            narrow.append((slot, first, after))
        else:
            for r in slot.wanted():
                (low, before, n), (high, _, _) = next(
                    pair for pair in zip(ends[slot.column], ends[slot.column][1:]) if sum(pair[0][1:]) <= r < pair[1][1]
                )
                gaps.setdefault((slot.column, low, high, before + n), set()).add(r)
    if gaps:
        found = _values_between(numeric, gaps)
        for slot in slots:
            slot.learn(found)
    if narrow:
        between = [F.when((F.col(s.column) > s.low) & (F.col(s.column) < s.high), F.col(s.column)) for s, _, _ in narrow]
        sketches = numeric.agg(*[F.kll_sketch_agg_double(b, F.lit(SKETCH)).alias(f"_{i}") for i, b in enumerate(between)])
        asked = []
        for i, (slot, first, after) in enumerate(narrow):
            shares = [(slot.wanted()[0] - first) / (after - first) - 2 * RANK_ERROR]
            shares.append((slot.wanted()[-1] - first) / (after - first) + 2 * RANK_ERROR)
            shares = F.array(*[F.lit(min(1.0, max(0.0, x))) for x in shares])
            asked.append(F.kll_sketch_get_quantile_double(f"_{i}", shares).alias(f"_{i}"))
        row = sketches.select(*asked).first()
        for i, (slot, first, after) in enumerate(narrow):
            (slot.low, slot.high), slot.expected = row[f"_{i}"], 8 * RANK_ERROR * (after - first)


def quantile_brackets(
    numeric: DataFrame, columns: Sequence[str], probabilities: dict[str, float], more: Sequence[Column] = ()
) -> Row:
    """One pass: numbers, NaNs and a first bracket of each quantile; ``more`` are further aggregates of that pass."""
    shares = [min(1.0, max(0.0, p + e)) for p in probabilities.values() for e in (-2 * RANK_ERROR, 2 * RANK_ERROR)]
    counts, sketches, ends = [], [], []
    for c in columns:
        counts += [F.count_if(F.col(c).isNotNull() & ~F.isnan(c)).alias(f"_n|{c}"), F.count_if(F.isnan(c)).alias(f"_nan|{c}")]
        sketches.append(F.kll_sketch_agg_double(F.col(c), F.lit(SKETCH)).alias(f"_sketch|{c}"))
        sketch = F.when(F.col(f"`_n|{c}`") > 0, F.col(f"`_sketch|{c}`"))  # an empty one cannot be asked
        ends.append(F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, shares))).alias(f"_ends|{c}"))
    row = numeric.agg(*counts, *sketches, *more)
    return row.select(*[F.col(f"`{c}`") for c in row.columns if not c.startswith("_sketch|")], *ends).first()


def bracketed_quantiles(
    numeric: DataFrame, first: Row, columns: Sequence[str], probabilities: dict[str, float]
) -> list[tuple]:
    """(column, quantiles) for double columns without -0.0, from the row of :func:`quantile_brackets`.

    The sketch of a column gives two values around each quantile. One pass counts the rows before and on them.
    What lies strictly between is a small share of the rows, whatever values repeat. A second pass sorts it or, where
    it is still long, sketches it again, and the bracket closes in; each round leaves about a hundredth. Only what
    lies in the last brackets is shuffled. A bracket that missed its rank is found out by the counts and begun anew.
    """
    slots: dict[tuple[str, str], _Slot] = {}
    for c in columns:
        numbers, n = first[f"_n|{c}"], first[f"_n|{c}"] + first[f"_nan|{c}"]
        for i, (name, p) in enumerate(probabilities.items()):
            if n:
                ends = first[f"_ends|{c}"][2 * i : 2 * i + 2] if numbers else (0.0, 0.0)
                slots[c, name] = _Slot(c, p, n, numbers, ends)
    while open_ := [s for s in slots.values() if s.wanted()]:
        _close_in(numeric, open_)
    return [(c, *[slots[c, p].result() if (c, p) in slots else None for p in probabilities]) for c in columns]


def as_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles; -0.0 becomes 0.0."""
    return df.select(*[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in columns])


def quantile_rows(spark: SparkSession, found: Sequence[tuple], probabilities: dict[str, float]) -> DataFrame:
    """One row per column that has values."""
    schema = "column_name string, " + ", ".join(f"`{name}` double" for name in probabilities)
    return spark.createDataFrame([r for r in found if any(v is not None for v in r[1:])], schema)


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per column; see :func:`bracketed_quantiles`.

    The columns are staged, as each round reads them again: what lies before them runs once.
    """
    numeric = stage(as_doubles(df, columns), "numbers")
    first = quantile_brackets(numeric, columns, probabilities)
    found = bracketed_quantiles(numeric, first, columns, probabilities)
    discard(numeric)
    return quantile_rows(df.sparkSession, found, probabilities)
