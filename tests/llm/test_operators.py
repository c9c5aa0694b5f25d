"""Corpus operators on small tables: brute force, round trips, and the cases that each docstring defines."""

import base64
import bz2
import collections
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from offerloom.llm import bpe, decontaminate, jaccard, passages, quality, secrets, token_counts, topk, toxicity, warc
from offerloom.session import shared_folder

FOLDER = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, score string, label string, component string"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    chosen = random.Random(seed)
    return " ".join(chosen.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and columns with clashing names."""
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "one two"), (4, prose(1, 20000)), (5, " \n ")]
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_odd_rows_give_one_result_each(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(1, 0, 1), (None, 1, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two"), (None, None)], "item_id bigint, text string")
    operators = [
        lambda d: quality.classify_quality(d, labels),
        lambda d: toxicity.classify_toxicity(d, labels),
        secrets.scan_secrets,
        jaccard.near_duplicates,
        lambda d: token_counts.count_tokens(d, VOCABULARY, f"{shared_folder(spark)}/test-cache-{tmp_path.name}"),
        lambda d: decontaminate.contamination(d, items),
        lambda d: bpe.round_trip_digests(d, VOCABULARY),
    ]
    for operator in operators:
        assert operator(odd).count() == 7
        assert operator(empty).count() == 0
    assert passages.repeated_passages(odd).count() == 0
    assert passages.repeated_passages(empty).count() == 0
    hit = {r["doc_id"]: r["contaminated"] for r in decontaminate.contamination(odd, items).collect()}
    assert hit[3] and hit[None] and not hit[1] and not hit[4]
    linked = sorted(((r["doc_id"] or 0, r["component_id"], r["n_shingles"]) for r in jaccard.near_duplicates(odd).collect()))
    assert linked[:5] == [(0, 3, 1), (1, 1, 0), (2, 2, 0), (3, 3, 1), (3, 3, 1)]


def test_filters_keep_columns_and_nulls(spark, odd):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.without_toxic(odd, labels).columns == odd.columns
    assert toxicity.without_toxic(odd, labels).count() == 7
    hidden = secrets.without_secrets(odd)
    assert hidden.columns == odd.columns and hidden.where(F.col("text").isNull()).count() == 1
    kept = sorted(r["doc_id"] for r in jaccard.without_near_duplicates(odd).collect())
    assert kept == [1, 2, 3, 3, 4, 5]


@pytest.mark.parametrize("operator, column", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, documents, operator, column):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    run = operator.classify_quality if column == "quality" else operator.classify_toxicity
    rows = run(documents, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r[column] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_keeps_every_telling_n_gram(spark):
    drawn = random.Random(6)
    telling = ["".join(drawn.choices("xyzjkvbq", k=12)) for _ in range(40)]
    rows = [(i, f"{prose(i, 20)} {' '.join(telling) if i < 60 else ''}") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(240)], "doc_id bigint, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    assert {int(g) for w in telling for g in toxicity.present(w)} <= {int(k) for k in model.keys}


def test_secrets_under_layers():
    secret = "password=abcdef123456XY"
    packed = base64.b64encode(gzip.compress(base64.b64encode(secret.encode()))).decode()
    for text in (
        secret,
        urllib.parse.quote(secret, safe=""),
        "".join(f"%{b:02X}" for b in secret.encode()),
        "".join(f"\\u{ord(c):04x}" for c in secret),
        base64.b64encode(secret.encode()).decode(),
        packed.rstrip("="),
        urllib.parse.quote(base64.b64encode(secret.encode()).decode(), safe=""),
    ):
        _, spans, unopened = secrets.find(f"é {text} end")
        assert any(s[0] <= 2 and s[1] >= len(text) for s in spans) and not unopened
        assert secret not in secrets.redact(text)
    assert secrets.find("retitioning thoninntingndrenterting " * 50)[1] == []
    assert secrets.as_text(secrets.find("token=token=abcdefghijklmnop secret: secret: abcdefghijklmnop")[0]) == "assign:0:28"
    assert secrets.as_text(secrets.find("AKIAABCDEFGHIJKLMN 0123456789abcdef")[0]) == "access:0:18,hex:19:35"


def test_secrets_beside_unusual_characters_and_faults():
    secret = "password=abcdef123456XY"
    for mark in ("\u00a0", "\u3000", "\u200b", "\u200d", "\u00ad", "\ufeff", "\0", "\x07"):
        text = base64.b64encode(f"{mark} {secret} {mark}".encode()).decode()
        assert secrets.find(text)[1] and text not in secrets.redact(text)
    escaped = "".join(f"%{b:02X}" for b in secret.encode())
    units = "".join(f"\\u{ord(c):04x}" for c in secret)
    broken = base64.b64encode(b"\xff\xfe " + secret.encode() + b" \xe3").decode()
    for text in (f"%FF{escaped}%C3", f"\\ud800{units}\\udc00", broken, base64.b64encode(gzip.compress(b"\xff" + secret.encode())).decode()):
        assert secrets.find(text)[1], text
    assert secrets.find("%FF%FE " * 20 + "\\ud800")[1] == []


def test_secrets_inside_longer_runs_wrapped_and_in_members():
    drawn = random.Random(8)
    secret = "password=abcdef123456XY"
    plain = base64.b64encode(secret.encode()).decode()
    noise = "".join(drawn.choices("ghijklmnop qrstuvw", k=400)).encode()
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        packed = pack(noise + b" " + secret.encode())
        blob = base64.b64encode(packed).decode()
        wrapped = base64.encodebytes(packed).decode().strip()
        escaped = "".join(f"%{b:02X}" for b in packed)
        for text in (f"https://h/path/{blob}", f"key_{blob}", f"id-{blob}", f"abc{blob}", wrapped, wrapped.replace("\n", "\r\n  "), escaped):
            assert secrets.find(text)[1], (pack, text)
            assert text[-60:] not in secrets.redact(f"{text} end")
        assert secrets.find(urllib.parse.quote(packed))[1]
    for head in ("https://h/path/", "key_", "id-", "abc", "x"):
        assert secrets.find(head + plain)[1] and plain not in secrets.redact(head + plain)
    assert secrets.find(plain[:12] + "\n" + plain[12:])[1]
    members = gzip.compress(b"first") + gzip.compress(secret[:9].encode()) + gzip.compress(secret[9:].encode())
    assert secrets.find(base64.b64encode(members).decode())[1]
    assert secrets.find(("plain words of a text\n" * 30) + "z" * 3000 + " 100%25 of it")[1] == []
    assert secrets.as_text(secrets.find("a=1&password%3Dabcdef123456XY&b=2")[1]) == "assign:4:29"


def test_base_spans_of_the_corpus_follow_their_patterns(documents):
    assign = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for row in documents.select("text").collect():
        want = [(m.start(), 0, m.end()) for m in re.finditer(assign, row["text"]) if len(m.group(1)) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", row["text"]) if len(m.group()) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", row["text"]) if len(m.group()) >= 16]
        assert [(s, k, e) for s, e, k in secrets.find(row["text"])[0]] == sorted(want)


def test_top_k_equals_all_products(spark):
    drawn = np.random.default_rng(3)
    rows = [(i, drawn.normal(size=6).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]  # one vector many times: ties
    rows += [(900, None), (901, [None] * 6), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [1.0] * 6)]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, score int").repartition(4)
    usable = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows[:360]}
    want = set()
    for q in (i for i in usable if i % 50 == 0):
        best = sorted((-int(usable[q] @ x), i) for i, x in usable.items() if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect()} == want
    assert topk.top_k(vectors.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    assert topk.top_k(vectors.where("false"), F.col("vec_id") == 0).count() == 0


def test_bpe_and_counts_equal_the_library(spark, documents):
    library = Tokenizer.from_file(VOCABULARY)
    drawn = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\x1c", "\x85", "é", "漢", "🙂", "'s", "<|endoftext|>", "1", "²", "!", "ß", "\x00"]
    texts = ["".join(drawn.choices(parts, k=drawn.randint(0, 40))) for _ in range(500)]
    texts += ["a" * 3000, "", " " * 500, "ab" * 2000] + [r["text"] for r in documents.limit(60).collect()]
    known = bpe.vocabulary(VOCABULARY)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert known.encode(texts) == want
    assert [known.decode(i) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]
    assert token_counts.counter(VOCABULARY)(texts) == [len(i) for i in want]
    rows = spark.createDataFrame(list(enumerate(texts[:40])), "doc_id bigint, text string")
    back = bpe.decode(bpe.encode(rows, VOCABULARY), VOCABULARY).collect()
    assert {r["doc_id"]: r["text"] for r in back} == dict(enumerate(texts[:40]))
    for r in bpe.round_trip_digests(rows, VOCABULARY).collect():
        ids = ",".join(map(str, want[r["doc_id"]]))
        assert r["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()


def test_token_cache_encodes_only_what_is_new(spark, tmp_path):
    folder = f"{shared_folder(spark)}/test-tokens-{tmp_path.name}"
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id bigint, text string")
    first = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(rows, VOCABULARY, folder).collect()}
    assert token_counts.read_cache(spark, folder).count() == 2
    more = rows.union(spark.createDataFrame([(4, "d e f")], "doc_id bigint, text string"))
    second = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(more, VOCABULARY, folder).collect()}
    assert first.items() <= second.items() and second[4] == 3
    stored = spark.read.parquet(folder)
    assert stored.count() == 3 and stored.select("version").distinct().count() == 1


def test_audit_finds_what_was_damaged(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    records = warc.archive(pages).cache()
    content = {r["position"]: bytes(r["content"]) for r in records.collect()}
    assert all(warc.parse_record(c)[2] for c in content.values())
    joined = b"".join(content[i] for i in sorted(content))
    assert [x for _, x in warc.split_archive(joined)] == [content[i] for i in sorted(content)]
    broken = records.where("position <> 40").withColumn(
        "content", F.when(F.col("position") == 7, F.encode(F.lit("gone"), "utf-8")).otherwise(F.col("content"))
    )
    own = warc.tree(records)
    found = {(r["position"], r["state"]) for r in warc.audit(own, warc.tree(broken)).collect()}
    assert found == {(7, "changed"), (40, "missing")}
    assert warc.audit(own, warc.tree(records)).count() == 0
    assert warc.fixity(pages.where("false")).count() == 0
    rows = warc.fixity(pages).collect()
    assert len(rows) == pages.count() and {r["state"] for r in rows} == {"intact"}


def test_passages_cover_every_exact_repeat(spark, documents):
    found = passages.repeated_passages(documents).collect()
    named = {r["doc_id"] for r in found} | {r["other_id"] for r in found}
    owners = collections.defaultdict(set)
    for row in documents.select("doc_id", "text").collect():
        words = row["text"].lower().split()
        for i in range(len(words) - 50):
            owners[tuple(words[i : i + 51])].add(row["doc_id"])
    assert set().union(*[s for s in owners.values() if len(s) > 1]) <= named
    assert all(r["identity"] >= 0.8 and r["end"] - r["start"] >= 50 for r in found)


def test_fuzzy_passage_and_clean_texts(spark):
    shared = prose(9, 90).split()
    edited = [w if i % 30 else "changed" for i, w in enumerate(shared)]
    rows = [(1, prose(10, 200) + " " + " ".join(shared)), (2, " ".join(edited) + " " + prose(11, 150)), (3, prose(12, 300))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in found} == {(1, 2), (2, 1)}


def test_exact_passages_on_both_sides_of_a_gap(spark):
    rows, want = [], []
    for n, (length, gap, other_gap) in enumerate([(60, 40, 40), (60, 60, 60), (60, 100, 100), (200, 150, 150), (80, 0, 200)]):
        head, tail = prose(100 + n, length), prose(200 + n, length)
        rows.append((2 * n, f"{head} {prose(300 + n, gap)} {tail}"))
        rows.append((2 * n + 1, f"{head} {prose(400 + n, other_gap)} {tail}"))
        want += [(2 * n, 0, length), (2 * n, length + gap, 2 * length + gap)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for doc, start, end in want:
        assert any(r["doc_id"] == doc and r["start"] <= start and r["end"] >= end for r in found)
    assert all(r["identity"] >= 0.8 for r in found)


def test_passages_of_recurring_lines(spark):
    line, refrain = prose(30, 33), prose(31, 12)
    song = lambda seed: " ".join(f"{prose(seed + i, 9)} {refrain}" for i in range(8))
    repeated = [
        " ".join(["la"] * 70),  # one word
        " ".join(["la di da"] * 40),
        " ".join([line] * 4),
        song(500),
        f"{prose(32, 40)} {line} {prose(33, 40)}",  # the line stands alone earlier in the second document
    ]
    rows = []
    for n, passage in enumerate(repeated):
        rows.append((2 * n, f"{prose(600 + n, 80)} {passage}"))
        rows.append((2 * n + 1, f"{line if n == 4 else ''} {prose(700 + n, 120)} {passage} {prose(800 + n, 10)}"))
    rows = rows[:2] + [(k + 100, t.replace("la", "do").replace("di", "re")) for k, t in rows[2:4]] + rows[4:]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for n, passage in enumerate(repeated):
        doc, length = (102 if n == 1 else 2 * n), len(passage.split())
        covered = {i for r in found if r["doc_id"] == doc for i in range(r["start"], r["end"])}
        assert set(range(80, 80 + length)) <= covered, n


def test_passage_whose_parts_are_common_elsewhere(spark):
    rows = []
    for trial in range(12):
        one, two = prose(1000 + trial, 30), prose(2000 + trial, 30)
        texts = [f"{prose(3000 + 10 * trial + i, 70)} {one} {two} {prose(4000 + 10 * trial + i, 70)}" for i in range(2)]
        texts += [f"{prose(5000 + 100 * trial + i, 50)} {(one, two)[i % 2]} {prose(9000 + 100 * trial + i, 50)}" for i in range(30)]
        rows += [(100 * trial + i, text) for i, text in enumerate(texts)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    named = {(r["doc_id"], r["other_id"]) for r in found if r["start"] <= 70 and r["end"] >= 130}
    assert {(100 * t, 100 * t + 1) for t in range(12)} | {(100 * t + 1, 100 * t) for t in range(12)} <= named


def test_chain_helpers_against_plain_ones():
    drawn = random.Random(1)
    for _ in range(50):
        a, b = ([drawn.randint(0, 5) for _ in range(drawn.randint(1, 25))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert passages.common_words(a, b) == table[-1][-1]


def test_edited_copies_near_the_threshold_keep_their_links(spark):
    drawn, texts = random.Random(4), []
    base = prose(20, 140).split()
    for i in range(60):
        words = list(base)
        for k in range(drawn.randint(0, 5)):
            words[drawn.randrange(len(words))] = f"edit{i}x{k}"
        texts.append(" ".join(words))
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    parent = list(range(60))
    for i in range(60):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(rows).collect()} == dict(enumerate(parent))
