"""The pipeline against its stages worked out plainly."""

import re

import corpus_pipeline
from offerloom.llm import secrets, toxicity

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def shingles(text):
    found = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def test_pipeline_equals_its_stages(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.fit(documents, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = {r["doc_id"]: r["text"] for r in documents.collect() if model.score(r["text"]) < 0.5}
    sets = {i: shingles(t) for i, t in kept.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    kept = {i: t for i, t in kept.items() if root[i] == i}
    windows = set()
    for row in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(row["text"])
        windows |= {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    clean = {}
    for i, text in kept.items():
        w = words(text)
        hit = {p for j in range(len(w) - 12) if tuple(w[j : j + 13]) in windows for p in range(j, j + 13)}
        if not hit or 20 * len(hit) < len(w):
            clean[i] = secrets.redact(text)
    docs = documents
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, FOLDER)
        assert docs.columns == documents.columns
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == clean
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()} == set(clean)
