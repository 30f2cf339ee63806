"""Byte-level BPE with a public rank file: encoding with segment trees, and decoding.

A pre-token's leaves hold the rank of the pair that starts at each byte position, the inner nodes the least rank and its
leftmost place. A merge reads the root, joins two live neighbours and updates at most three leaves and the nodes above
them. Short pre-tokens are merged together, a row of one array each; long ones by themselves.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kinespark.llm.common import keyed_text, small_batches

#: Pre-tokens that a worker remembers (some 100 MB); it forgets all when there are more.
CACHE = 400_000
#: Longest pre-token, in bytes, that is merged in an array with others.
SHORT = 32
#: Characters of text whose new pre-tokens are merged together.
TOGETHER = 4_000_000
_NONE = np.iinfo(np.int64).max


def load_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Codec:
    """Encoder and decoder for one vocabulary and one pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.find = regex.compile(pattern).findall
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        self.cache: dict[str, bytes] = {}
        keys, values = [], []
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(i)
        order = np.argsort(keys)
        self.pair_key = np.array(keys, dtype=np.int64)[order]
        self.pair_rank = np.array(values, dtype=np.int64)[order]
        self.pairs = dict(zip(keys, values, strict=True))

    # --- merging ---

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.pair_key, key)
        at[at == len(self.pair_key)] = 0
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as little-endian bytes, of pieces of at most SHORT bytes."""
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        width = 1 << max(1, int(lens.max() - 1).bit_length())
        rows = np.arange(n)
        flat = np.zeros(n * width, dtype=np.uint8)
        start = np.r_[0, np.cumsum(lens)[:-1]]
        within = np.arange(int(lens.sum())) - np.repeat(start, lens)
        flat[np.repeat(rows * width, lens) + within] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        token = self.byte[flat].reshape(n, width)
        column = np.arange(width)
        after = np.tile(column + 1, (n, 1))
        before = np.tile(column - 1, (n, 1))
        live = column[None, :] < lens[:, None]
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        pair = live[:, 1:]
        r = np.full((n, width - 1), -1, dtype=np.int64)
        r[pair] = self._ranks(token[:, :-1][pair], token[:, 1:][pair])
        tree[:, width : 2 * width - 1] = np.where(r >= 0, r * width + column[:-1], _NONE)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(who: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[who, node] = value
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])

        act = rows
        while True:
            root = tree[act, 1]
            keep = root != _NONE
            act, root = act[keep], root[keep]
            if not len(act):
                break
            left = root % width
            right = after[act, left]
            token[act, left] = root // width
            live[act, right] = False
            far = after[act, right]
            after[act, left] = far
            put(act, right, np.full(len(act), _NONE))
            near = far < lens[act]
            value = np.full(len(act), _NONE)
            i, p, q = act[near], left[near], far[near]
            before[i, q] = p
            found = self._ranks(token[i, p], token[i, q])
            value[near] = np.where(found >= 0, found * width + p, _NONE)
            put(act, left, value)
            back = left > 0
            i, q = act[back], left[back]
            p = before[i, q]
            found = self._ranks(token[i, p], token[i, q])
            put(i, p, np.where(found >= 0, found * width + p, _NONE))
        raw = token[live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_one(self, piece: bytes) -> bytes:
        """Ids of one piece of any length."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        token = self.byte[np.frombuffer(piece, dtype=np.uint8)]
        first = self._ranks(token[:-1], token[1:])
        leaves = np.full(2 * width, _NONE, dtype=np.int64)
        leaves[width : width + n - 1] = np.where(first >= 0, first * width + np.arange(n - 1), _NONE)
        k = width
        while k > 1:
            leaves[k // 2 : k] = np.minimum(leaves[k : 2 * k : 2], leaves[k + 1 : 2 * k : 2])
            k //= 2
        tree, token, none, pairs = leaves.tolist(), token.tolist(), int(_NONE), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, value: int) -> None:
            node = at + width
            tree[node] = value
            while node > 1:
                value = min(value, tree[node ^ 1])
                node >>= 1
                if tree[node] == value:
                    return
                tree[node] = value

        while tree[1] != none:
            rank, left = divmod(tree[1], width)
            right = after[left]
            far = after[right]
            token[left], token[right], after[left] = rank, -1, far
            put(right, none)
            if far < n:
                before[far] = left
                r = pairs.get(rank << 32 | token[far])
                put(left, none if r is None else r * width + left)
            else:
                put(left, none)
            p = before[left]
            if p >= 0:
                r = pairs.get(token[p] << 32 | rank)
                put(p, none if r is None else r * width + p)
        return np.array([t for t in token if t >= 0], dtype="<u4").tobytes()

    # --- texts ---

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of new pre-tokens into the cache."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for s in pieces:
            raw = s.encode("utf-8", "surrogatepass")
            whole = self.rank.get(raw)
            if whole is not None:
                self.cache[s] = whole.to_bytes(4, "little")
            elif len(raw) > SHORT:
                self.cache[s] = self.merge_one(raw)
            else:
                groups.setdefault((len(raw) - 1).bit_length(), []).append((s, raw))
        for own in groups.values():
            for a in range(0, len(own), 20_000):
                part = own[a : a + 20_000]
                self.cache.update(zip([s for s, _ in part], self.merge_many([raw for _, raw in part]), strict=True))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit numbers; null as empty. Some TOGETHER characters are split at a time."""
        own: list[list[str]] = []
        size = 0
        for k, text in enumerate(texts):
            own.append(self.find(text or ""))
            size += len(text or "")
            if size >= TOGETHER or k == len(texts) - 1:
                pieces = set().union(*own)
                new = pieces.difference(self.cache)
                if len(self.cache) + len(new) > CACHE:
                    self.cache.clear()
                    new = pieces
                self.learn(new)
                for parts in own:
                    yield b"".join(map(self.cache.__getitem__, parts))
                own, size = [], 0

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _codec(spark, path: str, pattern: str):
    shared = spark.sparkContext.broadcast((load_ranks(path), pattern))  # a vocabulary of fixed size
    own: list[Codec] = []

    def get() -> Codec:
        if not own:
            own.append(Codec(*shared.value))
        return own[0]

    return get


def encode(documents: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each text's token ids. Null texts count as empty; an empty text has no ids."""
    small_batches(documents.sparkSession)
    codec = _codec(documents.sparkSession, path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = list(codec().encode(batch.column(1).to_pylist()))
            offsets = np.r_[0, np.cumsum([len(x) // 4 for x in raw])].astype(np.int32)
            values = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "ids"])

    return keyed_text(documents, id_col, text_col).mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str = r"(?s).+", *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): texts of token ids. Null ids count as none; an id outside the vocabulary is an error."""
    small_batches(encoded.sparkSession)
    codec = _codec(encoded.sparkSession, path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [codec().decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], names=["doc_id", "text"])

    return encoded.select(f"`{id_col}`", f"`{ids_col}`").mapInArrow(work, "doc_id long, text string")


def round_trip(documents: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids: digests of both and the number of ids, a row for each row of documents."""
    small_batches(documents.sparkSession)
    codec = _codec(documents.sparkSession, path, pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for raw in codec().encode(batch.column(1).to_pylist()):
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(codec().decode(raw)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return keyed_text(documents, id_col, text_col).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
