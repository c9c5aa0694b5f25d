"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of a tree are the adjacent pairs of a piece, each with the rank of its merge and its
place; inner nodes hold the smaller child. The root is therefore the leftmost pair of lowest rank.
A merge changes at most three leaves, each with a logarithmic number of updates, until the root says
that nothing is left to merge. A run of a million characters costs n log n.

Texts are cut into pieces as a byte-level vocabulary asks for; merges never cross pieces. A worker
remembers short pieces it has encoded (``REMEMBERED`` at most, then it starts again), so that common
words are merged once. The new short pieces of a batch are merged side by side, one tree per row of
a numpy array; longer pieces have a tree of their own. Special strings inside a text become their one token, as the library does it.

Defined results: null is the empty text without tokens; every row is encoded on its own, repeated
rows alike; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import map_texts, text_column
from offerloom.llm.texthash import utf8
from offerloom.llm.token_counts import byte_alphabet

REMEMBERED = 300_000
SHORT = 32
NOTHING = 1 << 62
_UNICODE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
_ASCII = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""


class PairTree:
    """Minimum over (rank, place) of adjacent pairs, with point updates."""

    __slots__ = ("size", "nodes")

    def __init__(self, values: list[int]):
        size = 1
        while size < len(values):
            size *= 2
        self.size = size
        nodes = [NOTHING] * size + values + [NOTHING] * (size - len(values))
        for i in range(size - 1, 0, -1):
            left, right = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = left if left < right else right
        self.nodes = nodes

    def set(self, place: int, value: int) -> None:
        nodes, i = self.nodes, self.size + place
        nodes[i] = value
        while i > 1:
            other = nodes[i ^ 1]
            value = other if other < value else value
            i >>= 1
            if nodes[i] == value:
                return
            nodes[i] = value

    def root(self) -> int:
        return self.nodes[1]


class Vocabulary:
    """A byte-level BPE vocabulary file: merges, token bytes and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        alphabet = byte_alphabet()
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.single = [0] * 256
        for character, byte in alphabet.items():
            self.single[byte] = ids[character]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in ids.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        marks = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, marks))) if marks else None
        self._unicode, self._ascii = regex.compile(_UNICODE), re.compile(_ASCII)
        numbers = np.array([(a << 32) | b for a, b in self.merges])
        order = np.argsort(numbers)
        self._pairs = numbers[order]
        self._pair_rank = np.array([r for r, _ in self.merges.values()])[order]
        self._rank_id = np.array([i for _, i in self.merges.values()])
        first = self.merges
        self._byte_pairs = np.array(
            [[first.get((a, b), (NOTHING,))[0] for b in self.single] for a in self.single], dtype=np.int64
        )
        self._known: dict[str, tuple[int, bytes, bytes]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        ids = [self.single[b] for b in piece]
        count, merges = len(ids), self.merges
        if count < 2:
            return ids
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        # rank and place in one number: the smaller one is the leftmost pair of lowest rank
        def weigh(i: int, j: int) -> int:
            found = merges.get((ids[i], ids[j]))
            return NOTHING if found is None else found[0] * count + i

        tree = PairTree([weigh(i, i + 1) for i in range(count - 1)])
        nodes = tree.nodes
        while (root := nodes[1]) < NOTHING:
            i = root % count
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < count - 1:
                tree.set(j, NOTHING)
            if k < count:
                before[k] = i
                tree.set(i, weigh(i, k))
            elif i < count - 1:
                tree.set(i, NOTHING)
            if before[i] >= 0:
                tree.set(before[i], weigh(before[i], i))
        return [i for i in ids if i >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
        """Leaves for pairs of ids: rank and place in one number, or NOTHING."""
        keys = (left << 32) | right
        at = np.searchsorted(self._pairs, keys)
        at[at == len(self._pairs)] = 0
        return np.where(self._pairs[at] == keys, (self._pair_rank[at] << bits) | place, NOTHING)

    def merge_short(self, pieces: list[bytes], bits: int) -> list[list[int]]:
        """Token ids of pieces of 1 to 2 ** bits bytes, all merged side by side."""
        wide, count = 1 << bits, len(pieces)
        raw = np.frombuffer(b"".join([x.ljust(wide, b"\0") for x in pieces]), np.uint8).reshape(count, wide)
        length = np.array([len(x) for x in pieces])
        place = np.arange(wide)
        ids = np.full((count, wide + 1), -1, np.int64)  # the last column stands for "no neighbour"
        ids[:, :wide] = np.where(place < length[:, None], np.array(self.single)[raw], -1)
        after = np.minimum(np.tile(np.arange(1, wide + 2), (count, 1)), wide)
        after[np.arange(count), length - 1] = wide
        before = np.tile(np.arange(-1, wide), (count, 1))
        tree = np.full((count, 2 * wide), NOTHING)
        leaves = self._byte_pairs[raw[:, :-1], raw[:, 1:]]
        known = (leaves < NOTHING) & (place[1:] < length[:, None])
        tree[:, wide:-1][known] = ((leaves << bits) | place[:-1])[known]
        for node in range(wide - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        rows = np.arange(count)
        while len(rows := rows[tree[rows, 1] < NOTHING]):
            root = tree[rows, 1]
            i = root & (wide - 1)
            j = after[rows, i]
            k, h = after[rows, j], before[rows, i]
            made = self._rank_id[root >> bits]
            ids[rows, i], ids[rows, j] = made, -1
            after[rows, i], before[rows, k] = k, i
            tree[rows, wide + j] = NOTHING
            tree[rows, wide + i] = self._ranks(made, ids[rows, k], i, bits)
            left = self._ranks(ids[rows, h], made, h, bits)  # column -1 without a left neighbour
            other = np.where(h >= 0, h, j)
            tree[rows, wide + other] = np.where(h >= 0, left, NOTHING)
            for node in (wide + j, wide + i, wide + other):
                for _ in range(bits):
                    node = node >> 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        return [x[x >= 0].tolist() for x in ids]

    def _made(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        """Number of tokens, ids as text, and the bytes that the ids decode to."""
        return len(ids), ",".join(map(str, ids)).encode(), b"".join(map(self.bytes_of.__getitem__, ids))

    def forget(self) -> None:
        """Let go of the remembered pieces."""
        self._known.clear()

    def learn(self, pieces: set[str]) -> None:
        """Merge the pieces that are not remembered and are short."""
        short: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = utf8(piece)
            if len(raw) <= SHORT:
                short.setdefault(max(1, (len(raw) - 1).bit_length()), []).append((piece, raw))
        for bits, found in short.items():
            for (piece, _), ids in zip(found, self.merge_short([raw for _, raw in found], bits)):
                self._known[piece] = self._made(ids)

    def _parts(self, text: str):
        """Plain parts of a text and special strings between them, in order."""
        begin = 0
        for match in self._special.finditer(text) if self._special else ():
            yield text[begin : match.start()], match.group()
            begin = match.end()
        yield text[begin:], None

    def cut(self, text: str) -> list[tuple[list[str], str | None]]:
        """Pieces of each plain part and the special string after it."""
        return [((self._ascii if t.isascii() else self._unicode).findall(t), x) for t, x in self._parts(text)]

    def pieces(self, texts: list[str]):
        """Per text, what ``_made`` gives for its pieces."""
        cut = [self.cut(t) for t in texts]
        used = set().union(*[pieces for parts in cut for pieces, _ in parts])
        fresh = used - self._known.keys()
        if len(self._known) + len(fresh) > REMEMBERED:
            self._known.clear()
            fresh = used
        self.learn(fresh)
        known = self._known.get
        for parts in cut:
            made = []
            for pieces, special in parts:
                found = list(map(known, pieces))
                if None in found:  # long pieces are not remembered
                    found = [f or self._made(self.merge(utf8(p))) for f, p in zip(found, pieces)]
                made += found
                if special is not None:
                    made.append(self._made([self.special[special]]))
            yield made

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for _, ids, _ in made for i in ids.split(b",")] for made in self.pieces(texts)]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def digests(self, texts: list[str]):
        """Per text: number of tokens, SHA-256 of the comma-joined ids, SHA-256 of the decoded text."""
        for made in self.pieces(texts):
            counts, ids, decoded = zip(*made) if made else ((), (), ())
            ids, decoded = b",".join(ids), b"".join(decoded).decode("utf-8", "replace").encode()
            yield sum(counts), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """All columns of the rows, with token ids in place of the text."""
    rows = documents.withColumn("text", text_column())
    ids = lambda texts: {"ids": vocabulary(path).encode(texts)}
    return map_texts(rows, ids, "ids array<int>", at_end=lambda: vocabulary(path).forget())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The text of ``ids`` in its place; a null list decodes to the empty text."""
    rows = encoded.withColumn("text", F.coalesce(F.col("ids"), F.array().cast("array<int>"))).drop("ids")
    return map_texts(rows, lambda lists: {"__t": [vocabulary(path).decode(i) for i in lists]}, "__t string").withColumnRenamed(
        "__t", "text"
    )


def round_trip_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""

    def digests(texts: list[str]) -> dict:
        made = vocabulary(path).digests(texts)
        return dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), map(list, zip(*made))))

    rows = documents.select("doc_id", text_column().alias("text"))
    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_texts(rows, digests, added, at_end=lambda: vocabulary(path).forget())
