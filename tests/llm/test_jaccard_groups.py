"""Links among edited copies that are near the threshold, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import jaccard


def components(sets):
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    return dict(enumerate(parent))


def edited(drawn, words, edits, name):
    """The words with some replaced, left out, doubled or cut off."""
    words = list(words)
    for k in range(edits):
        at, way = drawn.randrange(len(words)), drawn.random()
        if way < 0.5:
            words[at] = f"{name}x{k}"
        elif way < 0.7:
            del words[at]
        elif way < 0.85:
            words.insert(at, drawn.choice(words))
        else:
            words[at] = drawn.choice(["red", "green", "blue"])  # edits that several copies share
    return words[: len(words) - drawn.choice([0, 0, 0, drawn.randint(0, 12)])]


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies_around_the_threshold(spark, seed):
    drawn = random.Random(seed)
    texts = []
    for family in range(4):
        size = drawn.choice([12, 60, 120, 300])
        base = [f"f{family}w{drawn.randrange(size * 2)}" for _ in range(size)]
        if family == 3:  # shares its first half with family 0
            base = texts[0].split()[: size // 2] + base[size // 2 :]
        for i in range(60):
            texts.append(" ".join(edited(drawn, base, drawn.randint(0, 2 + size // 18), f"s{seed}f{family}i{i}")))
    drawn.shuffle(texts)
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    expected = components(sets)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(rows).collect()} == expected
    assert 4 < len(set(expected.values())) < len(texts)


def test_opened_group_finds_the_links_of_members_and_guests(spark):
    """One group, whatever is in it: every link between different components is found, by a tie or by a meeting."""
    drawn = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    texts = [" ".join(base)] + [" ".join(edited(drawn, base, drawn.randint(3, 6), f"i{i}")) for i in range(80)]
    sets = {i: set(jaccard.shingles(t).view(np.int64).tolist()) for i, t in enumerate(texts)}
    known = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "sid bigint, tokens array<bigint>")
    rows = [(7, i, len(s), i, 0, len(sets), i % 3 != 0 or i == 0) for i, s in sets.items()]
    entered = spark.createDataFrame(rows, "grp bigint, sid bigint, n bigint, component bigint, leader bigint, many bigint, host boolean")
    differences = jaccard._differences(entered, known)
    ties = {(r["a"], r["b"]) for r in jaccard._near_leader(differences).collect()}
    met = {(r["a"], r["b"]) for r in jaccard._meeting_differences(differences).collect()}
    found = [(a, b) for a, b in ties | met if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert ties <= set(found)
    reach = {i: {i} for i in sets}
    for a, b in found:
        joined = reach[a] | reach[b]
        for i in joined:
            reach[i] = joined
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    hosts = {i for i in sets if i % 3 != 0 or i == 0}
    assert all(b in reach[a] for a, b in links if a in hosts or b in hosts)
    assert len(met) < len(sets) * (len(sets) - 1) / 8  # most pairs never meet


def test_differences_of_hash_sets(spark):
    rows = spark.createDataFrame([(1, 2, 4, 2, 1, 2, True), (1, 1, 3, 1, 1, 2, True)], "grp bigint, sid bigint, n bigint, component bigint, leader bigint, many bigint, host boolean")
    known = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 4, 5])], "sid bigint, tokens array<bigint>")
    found = {r["sid"]: (r["a"], sorted(r["differ"])) for r in jaccard._differences(rows, known).orderBy("sid").collect()}
    assert found == {1: (0, []), 2: (3, [1, 4, 5])}
    assert jaccard._near_leader(jaccard._differences(rows.where(F.lit(False)), known)).isEmpty()
