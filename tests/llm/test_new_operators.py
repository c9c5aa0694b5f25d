"""Vector codes, source divergence and suffix dedup against plain computations, and their defined cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from offerloom.llm import divergence, suffixes, vector_codes

DOCUMENT = "doc_id bigint, text string, lang string, source string, term string, k1 string, raw string"
VECTOR = "vec_id bigint, embedding array<float>, label int, x string, code string"


def documents(spark, texts, partitions=3):
    """Rows of (lang, source, text) or plain texts, with extra columns that clash with inner names."""
    rows = [(i, t[2], t[0], t[1]) if isinstance(t, tuple) else (i, t, "en", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCUMENT).repartition(partitions)


# Suffix dedup


def plain_dedup(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    found = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        found.append((spans, bytes(x for x, g in zip(b, gone) if not g)))
    return found


def check_dedup(spark, texts, length, group=suffixes.GROUP):
    rows = suffixes.without_repeats(documents(spark, texts), length, group).collect()
    got = {r["doc_id"]: ([(s["begin"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in rows}
    assert [got[i] for i in range(len(texts))] == plain_dedup(texts, length)


@pytest.mark.parametrize("seed, length, group", [(0, 8, 4096), (1, 16, 4096), (2, 33, 4096), (3, 16, 2), (4, 50, 5)])
def test_repeats_equal_brute_force(spark, seed, length, group):
    drawn = random.Random(seed)
    pool = ["".join(drawn.choices("abcé", k=drawn.randint(5, 80))) for _ in range(15)]

    def text():
        fresh = lambda: "".join(drawn.choices("abcé", k=drawn.randint(1, 30)))
        return "".join(drawn.choice(pool) if drawn.random() < 0.5 else fresh() for _ in range(drawn.randint(0, 12)))

    texts = [text() for _ in range(50)]
    check_dedup(spark, [*texts, "a" * 300, "aab" + "a" * 300, "ab" * 100, texts[3], texts[3], None, ""], length, group)


def test_repeats_of_exactly_the_length(spark):
    drawn = random.Random(7)
    fresh = lambda n: "".join(drawn.choices("abcdefgh ", k=n))
    exact, short, overlapping = fresh(200), fresh(199), fresh(300)
    texts = [fresh(50) + exact + fresh(70), fresh(5) + exact, short + fresh(9), fresh(9) + short]
    texts += [overlapping[:250], overlapping[50:], fresh(1000)]
    check_dedup(spark, texts, 200)
    assert [len(s) for s, _ in plain_dedup(texts, 200)] == [1, 1, 0, 0, 1, 1, 0]


def test_texts_longer_than_a_piece(spark, monkeypatch):
    drawn = random.Random(8)
    long = "".join(drawn.choices("abcdefgh ", k=3000))
    monkeypatch.setattr(suffixes, "PIECE", 97)
    raw, length = long.encode(), 40
    starts = [range(b, e + 1) for _, _, first, last in suffixes.anchors(raw, length) for b, e in zip(first, last)]
    assert sorted(s for r in starts for s in r) == list(range(len(raw) - length + 1))


def test_a_collision_of_hashes_is_found(monkeypatch):
    drawn = random.Random(9)
    raw = ["".join(drawn.choices("ab", k=30)).encode() for _ in range(40)]
    group, at, count = np.repeat([0, 1], 20), np.full(40, 10), np.ones(40, np.int64)
    right = suffixes.repeated_starts(group, raw, at, count, 8)
    monkeypatch.setattr(suffixes, "_BYTE", np.ones(257, np.uint64))  # all texts of one length share a hash
    assert (suffixes.repeated_starts(group, raw, at, count, 8) == right).all()
    assert right.any() and not right.all()


def test_suffixes_are_sorted(monkeypatch):
    drawn = random.Random(10)
    raw = ["".join(drawn.choices("ab", k=drawn.randint(0, 12))).encode() for _ in range(200)]
    group = np.sort(np.array([drawn.randint(0, 6) for _ in raw]))
    size = np.array([len(x) for x in raw])
    side = suffixes.Side(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size, 1)
    order, common = side.sorted(group)
    assert [(group[i], raw[i]) for i in order] == sorted(zip(group, raw))
    for a, b, c in zip(order, order[1:], common[1:]):
        plain = next((i for i, (x, y) in enumerate(zip(raw[a], raw[b])) if x != y), min(len(raw[a]), len(raw[b])))
        assert c == (plain if group[a] == group[b] else -1)


def test_dedup_of_odd_rows(spark):
    text = "".join(random.Random(11).choices("abcdefgh ", k=20000))
    rows = [(1, None), (2, ""), (3, "x" * 250), (None, text), (4, text), (4, text), (5, " \n ")]
    df = spark.createDataFrame([(*r, "en", "s", "t", "u", "v") for r in rows], DOCUMENT).repartition(3)
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.repeat_digests(df).collect())
    whole = [(0, 20000, 20000, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 250, 250, 1), (4, 20000, 20000, 1), (4, 20000, 20000, 1)]
    assert got == [*whole, (5, 3, 0, 0)]
    assert suffixes.repeat_digests(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffixes.without_repeats(df, 3)


# Vector codes


def plain_codes(rows, parts, entries, rounds):
    """Everything with Python's whole numbers and a full search."""
    kept = [(i, [int(np.floor(256.0 * float(np.float32(e)))) for e in x], label) for i, x, label in rows]
    longest = max(len(x) for _, x, _ in kept)
    width = -(-longest // parts)
    cut = [
        [(x + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)] for _, x, _ in kept
    ]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[list(cut[r][p]) for r in order] for p in range(parts)]

    def nearest(part, p):
        gaps = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in books[p]]
        return gaps.index(min(gaps)), min(gaps)

    for _ in range(rounds):
        made = [[nearest(row[p], p)[0] for p in range(parts)] for row in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [row[p] for row, codes in zip(cut, made) if codes[p] == e]
                if own:
                    books[p][e] = [sum(values) // len(own) for values in zip(*own)]
    final = [[nearest(row[p], p) for p in range(parts)] for row in cut]
    errors = [sum(gap for _, gap in row) for row in final]
    by_label = collections.Counter()
    for (_, _, label), error in zip(kept, errors):
        by_label[label] += error
    text = ",".join(str(v) for book in books for entry in book for v in entry)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{c:02x}" for c, _ in row), error, by_label[label], digest) for (i, _, label), row, error in zip(kept, final, errors)),
        key=repr,
    )


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], VECTOR).repartition(3)


def check_codes(spark, rows, usable=None):
    got = vector_codes.code_report(vectors(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_codes(usable or rows, 16, 64, 2)


def test_codes_equal_full_search(spark):
    drawn = np.random.default_rng(3)
    centres = drawn.normal(0, 0.2, (9, 32))
    rows = [(i, (centres[i % 9] + drawn.normal(0, 0.02, 32)).tolist(), i % 4 or None) for i in range(300)]
    check_codes(spark, [*rows, *rows[10:20], (None, rows[5][1], 7)])


def test_codes_with_fewer_rows_than_entries_and_ties(spark):
    check_codes(spark, [(i, [float(i % 3)] * 16, 1) for i in range(10)])


def test_codes_of_odd_rows(spark):
    usable = [(1, [0.5, -0.25, 0.1], None), (2, [], None), (3, [1.0] * 17, 4), (3, [1.0] * 17, 4)]
    dropped = [(4, None, 1), (5, [1.0, None], 1), (6, [float("nan")], 1), (7, [float("inf"), 1.0], 1)]
    check_codes(spark, usable + dropped, usable)
    assert vector_codes.code_report(vectors(spark, dropped)).count() == 0
    assert vector_codes.code_report(vectors(spark, usable).limit(0)).count() == 0
    huge = vector_codes.code_report(vectors(spark, [(1, [3e38] * 16, 1), (2, [1.0] * 16, 1), (3, [2e37] * 16, 1)])).collect()
    assert [r["error"] for r in sorted(huge, key=lambda r: r["vec_id"])] == [0, 0, 0]


def test_cells_leave_out_only_what_is_dominated():
    drawn = np.random.default_rng(4)
    books = drawn.integers(-130, 130, (4, 64, 5))
    books[:, 10] = books[:, 3]  # equal entries: the first counts
    x = drawn.integers(-150, 150, (500, 4, 5))
    x[:50] = books.transpose(1, 0, 2)[:50]
    gaps = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
    for memo in (vector_codes.MEMO, 7):
        grid = vector_codes.Grid(books, memo=memo)
        for _ in range(2):
            index, distance = grid.nearest(x)
            assert (index == gaps.argmin(axis=2)).all() and (distance == gaps.min(axis=2)).all()
        assert len(grid.memo) <= max(memo, 500) and grid.measured < 2 * gaps.size / 2
    large = vector_codes.Grid(books * (1 << 40))
    index, distance = large.nearest(x * (1 << 40))
    assert (index == gaps.argmin(axis=2)).all()
    assert (distance == gaps.min(axis=2).astype(object) * (1 << 80)).all()


# Source divergence


def plain_divergence(rows, ranks):
    rows = [tuple(v or "" for v in r) for r in rows]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    terms = [(g, s, re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t))) for g, s, t in rows]
    found = []
    for lang in {r[0] for r in rows}:
        documents = collections.Counter(t for g, _, ts in terms if g == lang for t in set(ts))
        kept = sorted(t for t, n in documents.items() if n >= 3)
        counts = {s: collections.Counter() for g, s, _ in terms if g == lang}
        for g, s, ts in terms:
            if g == lang:
                counts[s].update(t for t in ts if documents[t] >= 3)
        whole = sum(counts.values(), collections.Counter())

        def frequency(count, kept=kept):
            total = sum(count.values()) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        q, p = frequency(whole), {s: frequency(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            out = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", out, ranks)):
                items.sort(key=lambda e: (-e[1], e[0].encode()))
                found += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(found)


def check_divergence(spark, rows, ranks=200):
    got = divergence.source_divergence(documents(spark, rows), ranks)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows, ranks)


def corpus(seed, n):
    drawn = random.Random(seed)
    words = [*(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)), "Ärger", "ärger", "Σίγμας", "don't", "x1y", "Kelvin"]
    langs, sources = ["en", "de", None], [f"s{i}" for i in range(9)] + [None, "é"]
    return [
        (drawn.choice(langs), drawn.choice(sources), " ".join(drawn.choice(words) for _ in range(drawn.randint(0, 40))).upper() if drawn.random() < 0.2 else
         " ".join(words[min(int(drawn.expovariate(0.08)), len(words) - 1)] for _ in range(drawn.randint(0, 40))))
        for _ in range(n)
    ]


def test_divergence_equals_brute_force(spark):
    rows = corpus(1, 150)
    odd = [("fr", "only", "bare"), ("fr", None, None), ("it", "a", ""), (None, None, None), ("en", "empty", "...")]
    check_divergence(spark, [*rows, *rows[:5], *odd])
    check_divergence(spark, corpus(2, 60), ranks=3)


def test_divergence_over_several_sections_and_blocks(spark):
    rows = [r for r in corpus(3, 120) if r[0] == "en"] + [("en", "nothing", None)]
    numbers = {s: i for i, s in enumerate(sorted({r[1] or "" for r in rows}))}
    held = [(r[0], numbers[r[1] or ""], t) for r in rows for t in re.findall("[a-z]+", (r[2] or "").lower())]
    counts = collections.Counter(held)
    kept = spark.createDataFrame([(*k, n) for k, n in counts.items()], "lang string, g int, term string, n bigint")
    totals = collections.Counter()
    for (_, g, _), n in counts.items():
        totals[g] += n
    groups = spark.createDataFrame([("en", g, totals[g]) for g in numbers.values()], "lang string, g int, total bigint")
    terms = {k[2] for k in counts}
    sizes = spark.createDataFrame([("en", len(terms))], "lang string, terms bigint")
    values, _ = divergence.pair_values(kept, groups, sizes, sources_at_once=3, columns_at_once=5)
    got = {(r["g"], r["other"]): r["value"] for r in values.collect()}
    p = {g: {t: 1 + 10**9 * (counts[("en", g, t)] + 1) // (totals[g] + len(terms)) for t in terms} for g in numbers.values()}
    want = {(a, b): sum((p[a][t] - p[b][t]) ** 2 // p[b][t] for t in terms) for a in p for b in p if a != b}
    assert got == want


def test_divergence_of_no_rows_and_long_texts(spark):
    assert divergence.source_divergence(documents(spark, [("en", "a", "b")]).limit(0)).count() == 0
    raw = b"abc DEF " * 400_000 + b"x" * 3_000_000
    found = [t for piece in divergence.terms_of(raw) for t in piece]
    assert len(found) == 800_001 and found[:2] == [b"abc", b"def"] and found[-1] == b"x" * 3_000_000
