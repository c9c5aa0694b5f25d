"""Exact similarity join on word shingles with a token-group matrix.

A document is the set of its runs of five words (hashed to 64 bits); two documents link when the
Jaccard similarity of their sets is at least ``PERCENT`` %. Documents with equal sets are one class.

1. Grouping. Classes that share one of ``ROUNDS`` min-hashes are compared with a leader per min-hash
   (never with each other), if they agree in ``AGREE`` of them. Leaders are the classes whose min-hashes
   are the most common ones: edited copies of a text are nearer to it than to each other. Those not linked
   by then are compared with ``LEADERS`` more per min-hash. Links join classes into components; pairs with
   a similarity of ``KIN`` % or more also join components into groups, in which no link is claimed.
2. Matrix. Of every set of n, the n - ceil(0.8 n) + k tokens that come first in one fixed order are
   listed; two similar sets have at least k listed tokens in common (k is ``overlap(n)``). A group's row of the matrix is the union of its
   members' listed tokens. The order puts tokens that are frequent in the corpus last. Listed tokens
   of a single group are dropped at once; the rest of a set is its *usable* tokens.
3. Bound. Of two sets, take the one whose list ends first in the order: those of its listed tokens that
   are in the other set are listed there too. So the two share at most the listed tokens that they have
   in common and the unlisted ones of that set, and at most its usable tokens. A document can only link
   to a member of another group if enough of its listed tokens are in the group's row and one of the two has
   the usable tokens that their sizes ask for. Of two groups, the documents of the smaller one ask.
4. Opening. A group that is asked for, or that holds several components, is opened: its members and those
   who ask are written as their differences from one member, the most central. For sets of n and m tokens
   with a and b tokens of difference, the distance is a + b less twice the difference tokens they share, and
   they link when it is (n + m) / 9 at most. If a + b is no more than that already, both are linked to the
   one whose 9 a - n is the least, and are tied to it. Any other link needs so many shared difference
   tokens that the rarest of both lists meet: the first n / 8 + 1 of the one with the smaller a, the first
   m / 4 + 1 of the other. Pairs that meet, and can still share enough behind the place where they do, are
   compared on the whole sets.

Links inside a component need no further comparison. So no link between different components is lost,
copies are never expanded into pairs, and edited copies that are not quite similar meet only in what
is peculiar to them.

Defined results: null or empty texts have the empty set and form a component of their own; rows with
the same text are one class, whatever their ids; a row without doc_id can link others, and its
component is the smallest id there is in it (null without any); columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import drop_rows, keep_buckets, map_texts, ship, text_column, with_row_key
from offerloom.llm.components import connected_components
from offerloom.llm.texthash import mix, runs_of, word_hashes
from offerloom.sources.tables import discard, stage

WORDS = 5
PERCENT = 80
ROUNDS = 8
AGREE = 5
LEADERS = 8
KIN = 50
FREQUENT = 1 << 19
BITMAP_BITS = 24
_SEEDS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 3)) & ((1 << 64) - 1) for i in range(ROUNDS)], np.uint64)


def shingles(text: str) -> np.ndarray:
    return np.unique(runs_of(word_hashes(text), WORDS))


def _set_id(tokens: np.ndarray) -> int:
    return int(mix(np.array([mix(tokens).sum()], np.uint64) + np.uint64(len(tokens)))[0].view(np.int64))


def _describe(texts: list[str]) -> dict:
    """Set id, size and min-hashes per text; dealt out over the texts, tokens that several texts here have.

    In a single row, the tokens of many long texts would be several large objects in an executor at once.
    """
    sets = [shingles(t) for t in texts]
    lows = [
        [int((mix(s ^ seed)).min().view(np.int64)) for seed in _SEEDS] if len(s) else None for s in sets
    ]
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    often = counts >= 2
    return {
        "sid": [_set_id(s) if len(s) else None for s in sets],
        "n": [len(s) for s in sets],
        "lows": lows,
        "often": np.array_split(values[often].view(np.int64), len(texts)),
        "times": np.array_split(counts[often], len(texts)),
    }


def _frequent(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens seen (at most ``FREQUENT``) and their counts; they only set the order."""
    pairs = described.where(F.size("often") > 0).select(F.explode(F.arrays_zip("often", "times")).alias("p"))
    counted = pairs.groupBy(F.col("p.often").alias("token")).agg(F.sum("p.times").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top.column("n").to_numpy()[order]


def overlap(n: int) -> int:
    """Listed tokens that a set of ``n`` is to share with any similar set."""
    return 3 + n // 16


def _enough_usable(n, usable, low, other_usable):
    """Two sets share no more than the usable tokens of one of them; ``low`` is the other's least size."""
    least = F.greatest(20 * F.col(low), 16 * F.col(n))  # the other has 80 % of this size at least
    return 45 * F.greatest(usable, other_usable) >= 20 * F.col(n) + least


def _unlisted(n):
    return F.greatest(F.ceil(F.col(n) * PERCENT / 100) - 3 - F.floor(F.col(n) / 16), F.lit(0))


def _met_enough(n, low, high):
    """``met`` listed tokens can do for a set of ``n`` and some set of ``low`` to ``high`` tokens.

    Similar sets of n and m share 4/9 (n + m) tokens, and all but the unlisted ones of one of them are
    met. A set of m leaves less than 531/720 m unlisted.
    """
    n, low, high, met = map(F.col, (n, low, high, "met"))
    own = 320 * n + F.greatest(320 * low, 256 * n) - 720 * _unlisted("n")
    others = 320 * n - F.least(211 * high, 264 * n)
    return 720 * met >= F.least(own, others)


def listed(tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first tokens of a set in the common order, ``overlap`` more than a similar set can miss."""
    weight = np.zeros(len(tokens), np.int64)
    if len(frequent) and len(tokens):
        at = np.searchsorted(frequent, tokens)
        at[at == len(frequent)] = 0
        weight = np.where(frequent[at] == tokens, counts[at], 0)
    keep = len(tokens) - -(-PERCENT * len(tokens) // 100) + overlap(len(tokens))
    return tokens[np.lexsort((tokens, weight))[:keep]]


def _row_id():
    return F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64(text_column()))


def _whole_sets(sids: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """The whole sets of the classes in the column sid, staged."""
    wanted = stage(sids.distinct().join(nodes.select("sid", "rid"), "sid"), "wanted")
    rows = documents.select(_row_id().alias("rid"), text_column().alias("text"))
    rows = keep_buckets(rows, F.col("rid"), wanted.select("rid"))

    def sets(texts: list[str]) -> dict:
        found = [shingles(t) for t in texts]
        return {"sid": [_set_id(s) if len(s) else None for s in found], "tokens": [s.view(np.int64) for s in found]}

    known = map_texts(rows, sets, "sid bigint, tokens array<bigint>").join(wanted, ["sid", "rid"])
    known = stage(known.dropDuplicates(["sid", "rid"]).select("sid", "tokens"), "sets")
    discard(wanted)
    return known


def _compared(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids that are kin and whether they link, decided on the whole sets."""
    left = known.select(F.col("sid").alias("a"), F.col("tokens").alias("left"))
    right = known.select(F.col("sid").alias("b"), F.col("tokens").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("left", "right")).cast("long")
    union = F.size("left") + F.size("right") - common
    kin = both.where(100 * common >= KIN * union)
    return stage(kin.select("a", "b", (100 * common >= PERCENT * union).alias("linked")), "compared")


def _kin(pairs: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    pairs = stage(pairs, "pairs")
    known = _whole_sets(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")), documents, nodes)
    found = _compared(pairs, known)
    discard(pairs, known)
    return found


def _links(compared: DataFrame) -> DataFrame:
    return compared.where("linked").select("a", "b")


def _size_fits(n, low, high):
    """Some size from ``low`` to ``high`` is near enough to ``n``."""
    return (100 * F.col(n) >= PERCENT * F.col(low)) & (100 * F.col(high) >= PERCENT * F.col(n))


def _with_central(classes: DataFrame) -> DataFrame:
    """Add ``central``: how many classes share a min-hash with this one, summed over the min-hashes."""
    spread = classes.select("sid", F.posexplode("lows").alias("round", "low"))
    sizes = spread.groupBy("round", "low").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    central = spread.join(sizes, ["round", "low"]).groupBy("sid").agg(F.sum("m").alias("central"))
    return classes.join(central, "sid", "left").fillna(0, "central")


def _stars(nodes: DataFrame, leaders: int) -> DataFrame:
    """Pairs (a, b) of classes that are worth a comparison: b shares a min-hash with a leader a.

    Each min-hash has ``leaders`` leaders at most, so the pairs grow with the classes, however many
    of them share one. Classes that are connected already are left out.
    """
    low_bytes = "aggregate(transform(lows, (x, i) -> shiftleft(x & 255L, 8 * i)), 0L, (s, x) -> s | x)"
    spread = nodes.withColumn("sketch", F.expr(low_bytes)).select(
        "sid", "n", "central", "component", "sketch", F.posexplode("lows").alias("round", "low")
    )
    slot = F.pmod(F.xxhash64("round", "sid"), F.lit(leaders))
    one = F.struct((-F.col("central")).alias("rank"), F.xxhash64("sid", "round").alias("h"), "sid", "n", "component", "sketch")
    found = spread.groupBy("round", "low").agg(
        F.count("*").alias("m"), *[F.min(F.when(slot == i, one)).alias(f"l{i}") for i in range(leaders)]
    )
    found = found.where(F.col("m") > 1).select("round", "low", F.explode(F.array(*[f"l{i}" for i in range(leaders)])).alias("l"))
    found = found.where(F.col("l").isNotNull()).select(
        "round", "low", F.col("l.sid").alias("a"), F.col("l.n").alias("na"), F.col("l.component").alias("ca"), F.col("l.sketch").alias("sa")
    )
    differ = F.col("sketch").bitwiseXOR(F.col("sa"))
    same = sum((F.shiftrightunsigned(differ, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(ROUNDS))
    apart = (F.col("component") != F.col("ca")) & (same >= AGREE) & _size_fits("n", "na", "na")
    pairs = spread.join(found, ["round", "low"]).where(apart)
    return pairs.select(F.least("a", "sid").alias("a"), F.greatest("a", "sid").alias("b")).distinct()


def token_bitmap(tokens: DataFrame) -> np.ndarray:
    """One bit for the low bits of each token: 2 ** (BITMAP_BITS - 3) bytes, however many tokens."""
    low = F.col("token").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    bits = tokens.select(F.shiftright(low, 6).alias("word"), low.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def _with_components(nodes: DataFrame, edges: DataFrame, name: str = "component") -> DataFrame:
    found = connected_components(edges).withColumnsRenamed({"node": "sid", "component": name})
    return nodes.join(found, "sid", "left").withColumn(name, F.coalesce(name, "sid"))


def _with_groups(nodes: DataFrame, kin: DataFrame) -> DataFrame:
    """Add the component, the group, and of the group: its leader, its size, and whether it has several components."""
    grouped = _with_components(_with_components(nodes, _links(kin)), kin.select("a", "b"), "grp")
    grouped = stage(grouped.drop("lows", "doc_id"), "grouped")
    about = grouped.groupBy("grp").agg(
        F.max_by("sid", F.struct("central", "sid")).alias("leader"),
        F.count("*").alias("many"),
        (F.min("component") != F.max("component")).alias("mixed"),
    )
    return stage(grouped.drop("central").join(about, "grp"), "groups")


def _differences(entered: DataFrame, known: DataFrame) -> DataFrame:
    """Members and guests of the groups to open, as what distinguishes them from the group's leader.

    Columns: grp, sid, n, component, host (a member), a (tokens of difference), differ (those tokens, where
    the group has more than one member).
    """
    lead = known.select(F.col("sid").alias("leader"), F.col("tokens").alias("lead"))
    rows = entered.join(known, "sid").join(lead, "leader")
    both = F.concat(F.array_except("tokens", "lead"), F.array_except("lead", "tokens"))
    rows = rows.withColumn("differ", both).withColumn("a", F.size("differ").cast("long"))
    listed_ones = F.when(F.col("many") > 1, F.col("differ")).otherwise(F.expr("cast(array() as array<bigint>)"))
    return stage(rows.select("grp", "sid", "n", "component", "host", "a", listed_ones.alias("differ")), "differences")


def _near_leader(differences: DataFrame) -> DataFrame:
    """Links (a, b) of those that are as near to the leader as makes them similar, to the one nearest in that sense."""
    slack = 9 * F.col("a") - F.col("n")
    nearest = differences.groupBy("grp").agg(F.min(F.struct(slack.alias("slack"), "sid")).alias("m"))
    tied = differences.join(nearest, "grp").where((slack + F.col("m.slack") <= 0) & (F.col("sid") != F.col("m.sid")))
    return tied.select(F.col("sid").alias("a"), F.col("m.sid").alias("b"))


def _meeting_differences(differences: DataFrame) -> DataFrame:
    """Pairs (a, b) of an opened group, in different components, whose rarest difference tokens meet."""
    spread = differences.select("grp", "sid", "n", "component", "host", "a", F.explode("differ").alias("token"))
    counted = (
        spread.groupBy("grp", "token")
        .agg(F.count("*").alias("times"), F.max("host").alias("hosted"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where(F.col("hosted") & (F.col("low") < F.col("high")))
        .select("grp", "token", "times")
    )
    own = Window.partitionBy("grp", "sid")
    # tokens that no pair can share come first, then the rare ones
    place = F.col("a") - F.count("*").over(own) + F.row_number().over(own.orderBy("times", "token"))
    ranked = spread.join(counted, ["grp", "token"]).withColumn("place", place).drop("times")
    ranked = stage(ranked.where(4 * (F.col("place") - 1) <= F.col("n")), "rare-differences")
    one, two = ranked.where(8 * (F.col("place") - 1) <= F.col("n")).alias("l"), ranked.alias("r")
    la, ra, ln, rn = map(F.col, ("l.a", "r.a", "l.n", "r.n"))
    behind = F.least(la - F.col("l.place"), ra - F.col("r.place"))  # tokens that can be shared beside this one
    pairs = one.join(
        two,
        (F.col("l.grp") == F.col("r.grp"))
        & (F.col("l.token") == F.col("r.token"))
        & ((la < ra) | ((la == ra) & (F.col("l.sid") < F.col("r.sid"))))
        & (F.col("l.component") != F.col("r.component"))
        & (F.col("l.host") | F.col("r.host"))
        & (100 * ln >= PERCENT * rn)
        & (100 * rn >= PERCENT * ln)
        & (18 * (behind + 1) >= 9 * (la + ra) - ln - rn),
    )
    pairs = stage(pairs.select(F.least("l.sid", "r.sid").alias("a"), F.greatest("l.sid", "r.sid").alias("b")).distinct(), "pairs")
    discard(ranked)
    return pairs


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and the row keys of every row."""
    spark = documents.sparkSession
    keyed = with_row_key(documents.select("doc_id", text_column().alias("text"))).withColumn("rid", _row_id())
    added = "sid bigint, n bigint, lows array<bigint>, often array<bigint>, times array<bigint>"
    described = stage(map_texts(keyed, _describe, added, at_once=2048), "shingle-sets")
    classes = described.where(F.col("sid").isNotNull()).groupBy("sid").agg(
        F.min("doc_id").alias("doc_id"), F.min("rid").alias("rid"), F.first("n").alias("n"), F.min("lows").alias("lows")
    )
    classes = stage(classes, "classes")
    nodes = stage(_with_central(classes), "central-classes")
    discard(classes)

    # 1. groups of similar documents around leaders
    kin = _kin(_stars(nodes.withColumn("component", F.col("sid")), 1), documents, nodes)
    first = stage(_with_components(nodes, _links(kin)), "first-groups")
    kin = kin.unionByName(_kin(_stars(first, LEADERS), documents, nodes))
    discard(first)
    grouped = _with_groups(nodes, kin)

    # 2. listed tokens of every class, with its group
    shared = spark.sparkContext.broadcast(_frequent(described))

    def prefixes(texts: list[str]) -> dict:
        sets = [shingles(t) for t in texts]
        return {
            "sid": [_set_id(s) if len(s) else None for s in sets],
            "tokens": [listed(s, *shared.value).view(np.int64) for s in sets],
        }

    rows = documents.select(_row_id().alias("rid"), text_column().alias("text"))
    prefix = map_texts(rows, prefixes, "sid bigint, tokens array<bigint>").join(
        grouped.select("sid", "rid", "n", "grp", "many"), ["sid", "rid"]
    )
    prefix = stage(prefix.select("sid", "n", "grp", "many", "tokens"), "listed-tokens")
    shared.destroy()

    # 3. tokens of more than one group, and the documents and groups that meet there
    contested = (
        prefix.select("grp", F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.min("grp").alias("low"), F.max("grp").alias("high"))
        .where(F.col("low") < F.col("high"))
        .select("token")
    )
    marks = spark.sparkContext.broadcast(token_bitmap(contested))

    def only_contested(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column("tokens")
            tokens = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            low = tokens & ((1 << BITMAP_BITS) - 1)
            on = (marks.value[low >> 6] >> (low & 63)) & 1 == 1
            n = part.column("n").to_numpy()
            usable = n - np.bincount(owner[~on], minlength=part.num_rows)
            at = owner[on]
            kept = {c: part.column(c).take(pa.array(at)) for c in ("sid", "n", "grp", "many")}
            yield pa.RecordBatch.from_pydict({**kept, "usable": pa.array(usable[at]), "token": pa.array(tokens[on])})

    ship(spark)
    meeting = prefix.mapInArrow(only_contested, "sid bigint, n bigint, grp bigint, many bigint, usable bigint, token bigint")
    meeting = stage(meeting.distinct(), "contested-tokens")
    discard(prefix)
    marks.destroy()
    sizes = (
        meeting.select(F.col("grp").alias("other"), "sid", "n", "usable")
        .distinct()
        .groupBy("other")
        .agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("usable").alias("best"))
    )
    matrix = meeting.select("token", F.col("grp").alias("other"), F.col("many").alias("others")).distinct().join(sizes, "other")
    smaller = (F.col("many") < F.col("others")) | ((F.col("many") == F.col("others")) & (F.col("grp") < F.col("other")))
    bounded = (
        meeting.join(matrix, "token")
        .where(smaller & _size_fits("n", "least", "most") & _enough_usable("n", "usable", "least", "best"))
        .groupBy("sid", "n", "other", "least", "most")
        .agg(F.count("*").alias("met"))  # rows of both sides are distinct, so these are distinct tokens
        .where(_met_enough("n", "least", "most"))
    )
    asked = stage(bounded.select("sid", F.col("other").alias("grp")), "asked-groups")

    # 4. open the groups that are left
    about = asked.select("grp").distinct().withColumn("asked", F.lit(True))
    hosts = grouped.join(about, "grp", "left").where(F.col("mixed") | F.col("asked")).withColumn("host", F.lit(True))
    groups = grouped.where(F.col("sid") == F.col("leader")).select("grp", "leader", "many")
    guests = asked.join(grouped.select("sid", "n", "component"), "sid").join(groups, "grp").withColumn("host", F.lit(False))
    entries = ["grp", "sid", "n", "component", "leader", "many", "host"]
    entered = stage(hosts.select(*entries).unionByName(guests.select(*entries)), "entries")
    known = _whole_sets(entered.select("sid"), documents, nodes)
    differences = _differences(entered, known)
    more = stage(_near_leader(differences), "links").unionByName(_links(_compared(_meeting_differences(differences), known)))
    discard(meeting, asked, entered, known, differences)
    final = _with_components(nodes, _links(kin).unionByName(more))
    smallest = final.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stage(final.join(smallest, "component").select("sid", "component_id"), "components")

    joined = described.select("doc_id", "sid", "n", "__k1", "__k2").join(named, "sid", "left")
    own = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "__k1", "__k2")


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest id. Rows of one id are one document."""
    found = near_duplicates(documents)
    gone = stage(found.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("__k1", "__k2"), "near-copies")
    return drop_rows(with_row_key(documents), gone).select(*documents.columns)
