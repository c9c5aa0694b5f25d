"""Benchmark passages in documents, by winnowing; DataFrame functions only.

Words of documents and items are hashed in runs of ``GRAM``, and of every ``WINDOW`` runs in a row the
smallest hash is kept. With GRAM + WINDOW - 1 = LENGTH, any LENGTH words that two texts share give the
same kept hash on both sides, so no shared passage is missed. Kept hashes of items and documents are
joined; at every place of a matching document that has such a hash, the match is extended word by word
to both sides, and counts when it reaches LENGTH words. An item with fewer words counts as a whole: its
one run of all words is looked up among all runs of that length (at most LENGTH - 1 lengths).

Words have one form throughout, with A-Z lower-cased and nothing else: hashes and comparisons are of the same words.
Case mappings of whole texts would not do, as some hang on the neighbouring letters (final sigma).

No document moves with its text but those that share a hash with an item. Items are spread like any
table; Spark broadcasts their hashes when they are small, and splits a hash that very many documents
share when it joins by shuffle.

Defined results: null and empty texts have no words and no hits; rows with the same doc_id and text
get the same result, one row each; item ids that are null hit words but are not listed; without items
nothing is hit; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import drop_rows, keep_buckets, text_column, with_row_key
from offerloom.sources.tables import stage

LENGTH = 13
GRAM = 6
WINDOW = LENGTH - GRAM + 1
REACH = LENGTH - GRAM
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["__k1", "__k2"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), GAP), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _join_ahead(values: Column, ahead: int, join) -> Column:
    """``join`` of every value and the one ``ahead`` places after it; shorter by ``ahead``."""
    count = F.greatest(F.size(values) - ahead, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), count), F.slice(values, F.lit(ahead + 1), count), join)


def _runs(words: Column, length: int) -> Column:
    """Hash of each run of ``length`` words, in order; runs are put together from halves, as in doubling."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def longer(known: Column, have: int) -> Column:
        if have == length:
            return known
        step = min(have, length - have)  # overlapping runs are as good as adjoining ones
        return _let(_join_ahead(known, step, lambda a, b: F.xxhash64(a, b)), lambda next_: longer(next_, have + step))

    return _let(hashes, lambda known: longer(known, 1))


def winnow(hashes: Column) -> Column:
    """The distinct smallest hashes of all windows; nothing of a list shorter than one window."""

    def wider(known: Column, have: int) -> Column:
        if have == WINDOW:
            return F.array_distinct(known)
        step = min(have, WINDOW - have)
        return _let(_join_ahead(known, step, lambda a, b: F.least(a, b)), lambda next_: wider(next_, have + step))

    return wider(hashes, 1)


def item_places(benchmark: DataFrame) -> DataFrame:
    """Every place of an item that has a kept hash: hash, length of the run, words around it."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"),
        words_of(text_column()).alias("words"),
    ).where(F.size("words") > 0)
    long = items.where(F.size("words") >= LENGTH).withColumn("run", F.lit(GRAM)).withColumn("hashes", _runs(F.col("words"), GRAM))
    long = long.withColumn("kept", winnow(F.col("hashes")))
    short = items.where(F.size("words") < LENGTH).withColumn("run", F.size("words"))
    short = short.withColumn(
        "hashes",
        F.coalesce(*[F.when(F.col("run") == n, _runs(F.col("words"), n)) for n in range(1, LENGTH)]),
    ).withColumn("kept", F.col("hashes"))
    places = long.unionByName(short).select("item_id", "words", "run", "kept", F.posexplode("hashes").alias("place", "hash"))
    places = places.where(F.array_contains("kept", F.col("hash")))
    return places.select("item_id", "run", "hash", *_around(F.col("words"), F.col("place"), F.col("run"), "item")).distinct()


def _around(words: Column, place: Column, run: Column, name: str) -> list[Column]:
    """The words of the run, those before it (nearest first), and those after it."""
    first = F.greatest(place - REACH, F.lit(0))
    return [
        F.slice(words, place + 1, run).alias(f"{name}_run"),
        F.reverse(F.slice(words, first + 1, place - first)).alias(f"{name}_before"),
        F.slice(words, place + run + 1, REACH).alias(f"{name}_after"),
    ]


def _spots(words: Column, length: int) -> Column:
    return F.transform(
        _runs(words, length),
        lambda h, i: F.struct(i.alias("place"), h.alias("hash"), F.lit(length).alias("run")),
    )


def _equal_ahead(left: str, right: str) -> Column:
    """How many words two lists have in common from their start."""
    same = F.zip_with(left, right, lambda a, b: F.coalesce(a == b, F.lit(False)))
    return _let(same, lambda s: F.when(F.array_position(s, False) == 0, F.size(s)).otherwise(F.array_position(s, False) - 1))


def find_hits(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document with hits (row keys): the hit runs (start, end) and the items."""
    places = stage(item_places(benchmark), "benchmark-places")
    lengths = sorted(r["run"] for r in places.select("run").distinct().collect())  # LENGTH at most
    hashes = stage(places.select("hash").distinct(), "benchmark-hashes")
    texts = with_row_key(documents.select("doc_id", text_column().alias("text")))

    def all_kept(words: Column) -> Column:
        kept = [_let(_runs(words, GRAM), winnow)]
        kept += [_runs(words, n) for n in lengths if n != GRAM]
        # short items of GRAM words need every run, not only the kept ones
        kept += [_runs(words, GRAM)] if whole_gram else []
        return F.array_distinct(F.concat(*kept))

    whole_gram = GRAM in lengths and not places.where(
        (F.col("run") == GRAM) & (F.size("item_before") + F.size("item_after") == 0)
    ).isEmpty()
    kept = texts.select(*KEY, F.explode(_let(words_of(F.col("text")), all_kept)).alias("hash"))
    found = stage(kept.join(hashes, "hash").groupBy(*KEY).agg(F.collect_set("hash").alias("found")), "matching-documents")

    near = keep_buckets(texts, F.col("__k1"), found.select("__k1")).join(found, KEY).dropDuplicates(KEY)
    near = near.select(*KEY, "found", words_of(F.col("text")).alias("words"))
    spots = [F.filter(_spots(F.col("words"), n), lambda s: F.array_contains("found", s["hash"])) for n in lengths]
    spots = F.concat(*spots) if spots else F.array().cast("array<struct<place:int,hash:bigint,run:int>>")
    spread = near.select(*KEY, "words", F.explode(spots).alias("spot")).select(
        *KEY,
        "spot.*",
        *_around(F.col("words"), F.col("spot.place"), F.col("spot.run"), "doc"),
    )
    met = spread.join(places, ["hash", "run"]).where(F.col("doc_run") == F.col("item_run"))
    before = _equal_ahead("doc_before", "item_before").cast("int")
    after = _equal_ahead("doc_after", "item_after").cast("int")
    whole_item = F.size("item_before") + F.size("item_after") == 0
    reached = met.withColumns({"start": F.col("place") - before, "end": F.col("place") + F.col("run") + after}).where(
        (F.col("end") - F.col("start") >= LENGTH) | (whole_item & (F.col("run") < LENGTH))
    )
    return reached.groupBy(*KEY).agg(
        F.collect_set(F.struct("start", "end")).alias("runs"), F.collect_set("item_id").alias("items")
    )


def contamination(documents: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """Per document: words, hit words, items and their digest; contaminated if 1 / ``share`` of the words are hit."""
    hits = find_hits(documents, benchmark).select(
        *KEY,
        F.size(
            F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["end"] - 1))))
        ).alias("n_hit"),
        F.array_sort("items").alias("items"),
    )
    rows = with_row_key(documents).select(*KEY, "doc_id", F.regexp_count(text_column(), F.lit(WORD)).cast("long").alias("n_words"))
    joined = rows.join(hits, KEY, "left")
    n_hit = F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long"))
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        *KEY,
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """The rows that are not contaminated, unchanged."""
    bad = stage(contamination(documents, benchmark, share).where("contaminated").select(*KEY), "contaminated")
    return drop_rows(with_row_key(documents), bad).select(*documents.columns)
