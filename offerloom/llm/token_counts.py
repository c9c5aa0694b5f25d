"""Token counts of documents with a digest cache.

A text and a tokenizer version each have a SHA-256 digest. Stored counts (Parquet, appended to, in a
folder every executor can read) are joined by both digests. Only texts without a stored count are
encoded, each distinct text once, and their counts are appended before the result is read from the
cache. A run that is ended between the two loses nothing but its work: appended parts are complete,
and the same digest appended twice carries the same count.

The version digest is that of the tokenizer file, so a changed vocabulary never meets old counts.
``normalise`` is the Unicode form that is applied to a text before digest and count; the default
keeps texts as they are.

Defined results: null is the empty text with 0 tokens; repeated texts share one cache row; an empty
table gives an empty result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import map_texts, text_column

CACHE_SCHEMA = "text_digest binary, version string, n_tokens bigint"
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def version_of(vocabulary: str) -> str:
    with open(vocabulary, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _as_ranks(spec: dict):
    """Vocabulary of plain byte-level merges as token bytes to id, or None if the file asks for more."""
    model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        spec.get("normalizer") is None
        and splitter.get("type") == "ByteLevel"
        and splitter.get("use_regex", True)
        and not splitter.get("add_prefix_space")
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    )
    if not plain:
        return None
    alphabet, vocabulary = byte_alphabet(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocabulary[a + b] for a, b in pairs]
    added = {t["content"] for t in spec["added_tokens"]}
    single = [t for t in vocabulary if len(t) > 1 and t not in added]
    if order != sorted(set(order)) or len(single) != len(order):  # merges have to be in the order of the ids
        return None
    return {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items() if t not in added}


@cache
def counter(vocabulary: str):
    """list of texts -> list of token counts, as the library for the file gives them."""
    if vocabulary.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]

    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    exact.no_padding()
    exact.no_truncation()

    def one_by_one(texts: list[str]) -> list[int]:
        return [len(exact.encode(t, add_special_tokens=False).ids) for t in texts]

    with open(vocabulary, encoding="utf-8") as file:
        spec = json.load(file)
    ranks = _as_ranks(spec)
    if ranks is None:
        return one_by_one

    import tiktoken

    # the same merges in a faster library; special strings count as one token, as they do in the other one
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    quick = tiktoken.Encoding(version_of(vocabulary), pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens=special)

    def count(texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            try:
                out.append(len(quick.encode(text, allowed_special="all")))
            except (ValueError, UnicodeError):  # a text its pattern matcher gives up on
                out += one_by_one([text])
        return out

    return count


def digests(documents: DataFrame, normalise: str | None = None) -> DataFrame:
    rows = documents.withColumn("text", text_column())
    if normalise:
        rows = map_texts(rows, lambda texts: {"__t": [unicodedata.normalize(normalise, t) for t in texts]}, "__t string")
        rows = rows.withColumnRenamed("__t", "text")
    return rows.withColumn("text_digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def read_cache(spark, folder: str) -> DataFrame:
    """Stored counts, one per text and version; empty if the folder has none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(folder).groupBy("text_digest", "version").agg(
        F.min("n_tokens").alias("n_tokens")
    )


def fill_cache(documents: DataFrame, vocabulary: str, cache_folder: str, normalise: str | None = None) -> None:
    """Encode each distinct text without a stored count and append the counts."""
    version = version_of(vocabulary)
    known = read_cache(documents.sparkSession, cache_folder).where(F.col("version") == version)
    texts = digests(documents, normalise).select("text_digest", "text")
    missing = texts.join(known.select("text_digest"), "text_digest", "left_anti")
    # copies meet in the tasks that read them first, so a text with many copies is moved a few times only
    once = missing.groupBy("text_digest").agg(F.first("text").alias("text"))
    counted = map_texts(once, lambda t: {"n_tokens": counter(vocabulary)(t)}, "n_tokens bigint")
    rows = counted.select("text_digest", F.lit(version).alias("version"), "n_tokens")
    rows.write.mode("append").parquet(cache_folder)


def count_tokens(
    documents: DataFrame, vocabulary: str, cache_folder: str, limit: int = 512, normalise: str | None = None
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    fill_cache(documents, vocabulary, cache_folder, normalise)
    stored = read_cache(documents.sparkSession, cache_folder).where(F.col("version") == version_of(vocabulary))
    rows = digests(documents, normalise).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text_digest"
    )
    return rows.join(stored.select("text_digest", "n_tokens"), "text_digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
