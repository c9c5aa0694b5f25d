"""Source divergence audit: how far the word frequencies of each source are from others of its language.

Columns of counts (a term's occurrences in every source of a language) repeat a great deal: most terms
are rare and absent from most sources. The vocabulary is reordered so that equal columns lie together;
each is kept once, with the number of terms it stands for. Along that order the counts of one source come in
runs of equal values. For a pair of sources the borders of both run lists are intersected; between two
borders both frequencies are constant, so f is worked out once and multiplied by the run's length.

Work is split three ways, and no task holds all sources or all terms: sources are numbered within their
language and dealt into sections of ``SECTION``, each pair of sections has its own columns, and
these go by a hash into blocks of some ``COLUMNS`` different columns. Terms are counted inside the tasks
before they are shuffled.

Defined results: a null text, language or source counts as ''. Terms are runs of A-Z, a-z and characters
from U+0080 on; only A-Z is lower-cased. Repeated rows count as documents of their own. A group without kept
terms has count 0 in all. A language without kept terms gives pairs of value 0 and no terms. All
arithmetic is on whole numbers. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import ship
from offerloom.sources.tables import discard, stage

SCALE = 1_000_000_000
MIN_DOCUMENTS = 3
RANKS = 200
SECTION = 128
COLUMNS = 4096
PIECE = 1 << 20
HELD = 1 << 18
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, piece by piece; no piece ends inside a term."""
    raw, at = raw.translate(_LOWER), 0
    while at < len(raw):
        gap = _GAP.search(raw, at + PIECE)
        end = gap.start() if gap else len(raw)
        yield _TERM.findall(raw, at, end)
        at = end


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source; the empty term marks the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        found = [(*g, t, n[t], df[t]) for g, (n, df) in held.items() for t in n]
        columns = list(zip(*found))
        return pa.RecordBatch.from_pydict(
            {
                "lang": pa.array(columns[0], pa.string()),
                "source": pa.array(columns[1], pa.string()),
                "term": pa.array(columns[2], pa.binary()),
                "n": pa.array(columns[3], pa.int64()),
                "docs": pa.array(columns[4], pa.int64()),
            }
        )

    for part in parts:
        for lang, source, raw in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "raw"))):
            n, documents = held.setdefault((lang, source), (Counter({b"": 0}), Counter()))
            before, here = len(n), set()
            for terms in terms_of(raw):
                n.update(terms)
                here.update(terms)
            documents.update(here)
            size += len(n) - before
            if size > HELD:
                yield rows()
                held, size = {}, 0
    if held:
        yield rows()


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), with a row for the empty term in every group."""
    ship(documents.sparkSession)
    lang, source, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text"))
    rows = documents.select(lang.alias("lang"), source.alias("source"), text.cast("binary").alias("raw"))
    parts = rows.mapInArrow(_counted, "lang string, source string, term binary, n bigint, docs bigint")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def frequencies(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)), worked out once per different count."""
    values, at = np.unique(counts, return_inverse=True)
    known = [1 + SCALE * (int(v) + 1) // (total + terms) if terms else 1 for v in values]
    return np.array(known, np.int64)[at]


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def run_products(p: np.ndarray, q: np.ndarray, borders: np.ndarray, upto: np.ndarray) -> tuple[int, int]:
    """Sums of floor((p-q)^2/q) and floor((q-p)^2/p) over all terms; ``upto`` counts the terms before each column."""
    p, q = p[borders], q[borders]
    length = np.diff(np.append(upto[borders], upto[-1]))
    square = (p - q) ** 2
    return int((square // q * length).sum()), int((square // p * length).sum())


def _block_values(key: tuple, columns: pd.DataFrame, groups: pd.DataFrame, section: int) -> pd.DataFrame:
    """Part of the values of all pairs of two sections, from one block of columns."""
    own, other = int(key[1]), int(key[2])
    totals = {int(g["g"]): int(g["total"]) for row in groups.itertuples() for g in row.groups}
    terms = int(groups.terms.iloc[0])
    filled = [[(int(e["g"]), int(e["n"])) for e in vector] for vector in columns.vector]
    order = sorted(range(len(filled)), key=lambda i: filled[i])
    upto = np.concatenate([[0], np.cumsum(columns.length.to_numpy()[order])])
    numbers = sorted(totals)
    row_of = {g: i for i, g in enumerate(numbers)}
    counts = np.zeros((len(numbers), len(order)), np.int64)
    for column, i in enumerate(order):
        for g, n in filled[i]:
            counts[row_of[g], column] = n
    begins = [runs(row) for row in counts]
    p = np.stack([frequencies(row, totals[g], terms) for g, row in zip(numbers, counts)])
    found = []
    for i, x in enumerate(numbers):
        for j in range(i + 1, len(numbers)):
            y = numbers[j]
            if own != other and x // section == y // section:
                continue  # pairs within a section have blocks of their own
            there, back = run_products(p[i], p[j], np.union1d(begins[i], begins[j]), upto)
            found += [(x, y, there), (y, x, back)]
    return pd.DataFrame(found, columns=["g", "other", "value"]).assign(lang=key[0])


def pair_values(
    kept: DataFrame, groups: DataFrame, sizes: DataFrame, sources_at_once: int = SECTION, columns_at_once: int = COLUMNS
) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, g, other, value) for every two sources of a language; and staged tables to discard.

    ``kept`` has lang, g, term, n (n > 0), ``groups`` lang, g, total, ``sizes`` lang, terms.
    """
    section = F.floor(F.col("g") / sources_at_once)
    sections = groups.groupBy("lang", section.alias("section")).agg(F.collect_list(F.struct("g", "total")).alias("groups"))
    left, right = (sections.select("lang", F.col("section").alias(c), F.col("groups").alias(f"groups_{c}")) for c in "ab")
    pairs = left.join(right, "lang").where("a <= b").join(sizes, "lang")
    both = F.when(F.col("a") == F.col("b"), F.col("groups_a")).otherwise(F.concat("groups_a", "groups_b"))
    pairs = stage(pairs.select("lang", "a", "b", both.alias("groups"), "terms"), "section-pairs")
    meets = pairs.select("lang", "a", "b")
    meets = meets.withColumn("section", F.explode(F.array_distinct(F.array("a", "b"))))
    counted = kept.withColumn("section", section).join(meets, ["lang", "section"])
    vectors = counted.groupBy("lang", "a", "b", "term").agg(F.sort_array(F.collect_list(F.struct("g", "n"))).alias("vector"))
    columns = vectors.groupBy("lang", "a", "b", "vector").agg(F.count("*").alias("length"))
    columns = stage(columns, "columns")
    filled = columns.groupBy("lang", "a", "b").agg(F.count("*").alias("m"), F.sum("length").alias("filled"))
    known = pairs.join(filled, ["lang", "a", "b"], "left").fillna(0, ["m", "filled"])
    known = known.withColumn("blocks", F.ceil((F.col("m") + 1) / columns_at_once).cast("int"))
    known = stage(known, "section-blocks")
    spread = F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int")
    dealt = columns.join(known.select("lang", "a", "b", "blocks"), ["lang", "a", "b"])
    dealt = dealt.select("lang", "a", "b", spread.alias("block"), "vector", "length")
    # terms that no source of the two sections has
    absent = known.select(
        "lang", "a", "b", F.lit(0).alias("block"),
        F.array().cast("array<struct<g:int,n:bigint>>").alias("vector"),
        (F.col("terms") - F.col("filled")).alias("length"),
    )
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    heads = known.select("lang", "a", "b", block, "groups", "terms")
    keys = ["lang", "a", "b", "block"]
    values = dealt.unionByName(absent).groupBy(*keys).cogroup(heads.groupBy(*keys))

    def block_values(key: tuple, block_columns: pd.DataFrame, block_heads: pd.DataFrame) -> pd.DataFrame:
        return _block_values(key, block_columns, block_heads, sources_at_once)

    values = values.applyInPandas(block_values, "lang string, g int, other int, value bigint")
    return values.groupBy("lang", "g", "other").agg(F.sum("value").alias("value")), [pairs, columns, known]


def source_divergence(documents: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources, and the terms that stand out."""
    counts = stage(term_counts(documents), "term-counts")
    named = counts.where("term = ''").select("lang", "source")
    named = named.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    frequent = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    frequent = stage(frequent.where(F.col("docs") >= MIN_DOCUMENTS).drop("docs"), "kept-terms")
    named = stage(named, "source-numbers")
    kept = counts.where("n > 0").drop("docs").join(frequent, ["lang", "term"]).join(named, ["lang", "source"])
    kept = stage(kept, "kept-counts")
    sizes = frequent.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    sizes = named.select("lang").distinct().join(sizes, "lang", "left").fillna(0, ["terms", "lang_total"])
    totals = kept.groupBy("lang", "g").agg(F.sum("n").alias("total"))
    groups = named.join(totals, ["lang", "g"], "left").fillna(0, ["total"])
    sizes, groups = stage(sizes, "lang-sizes"), stage(groups, "groups")

    def frequency(count: str, total: str) -> Column:
        return F.expr(f"1 + cast({SCALE} * cast({count} + 1 as decimal(28,0)) div ({total} + terms) as bigint)")

    standing = kept.join(groups.select("lang", "g", "total"), ["lang", "g"]).join(sizes, "lang")
    standing = standing.withColumns({"p": frequency("n", "total"), "q": frequency("lang_n", "lang_total")}).where("p > q")
    standing = standing.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    numbers = named.select("lang", "g", "source")
    others = named.select("lang", F.col("g").alias("other"), F.col("source").alias("item"))
    pairs, staged = pair_values(
        kept.select("lang", "g", "term", "n"), groups.select("lang", "g", "total"), sizes.select("lang", "terms")
    )
    pairs = pairs.join(numbers, ["lang", "g"]).join(others, ["lang", "other"]).select("lang", "source", "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumns({"part": F.lit("pair"), "rank": F.row_number().over(order)})
    standing = standing.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    standing = standing.withColumn("part", F.lit("term"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    result = stage(pairs.select(names).unionByName(standing.select(names)), "divergence")
    discard(counts, frequent, named, kept, sizes, groups, *staged)
    return result
