"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Leaf i of the tree holds the rank of the pair that starts at live position i (or none); every inner node holds the
smallest rank below it, the leftmost on ties. A merge reads the root, removes one live position and updates the two
pairs that changed, each in logarithmic time, so a piece of n bytes takes O(n log n) whatever its pairs are.

Defined results: null is encoded as the empty text, with no ids. Repeated rows give repeated results. Other columns are
ignored. Decoding ids gives back the text's UTF-8 bytes; an id outside the vocabulary raises KeyError.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_column, text_of
from .pieces import Cache, splitter

def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the piece itself if it has a rank, else what repeated merges of the lowest pair leave."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    bits = n.bit_length()
    none = 1 << 32 + bits  # above every rank, which has 32 bits, at any length; a leaf is rank and place in one small number
    size = 1 << (n - 2).bit_length() if n > 1 else 1
    end = list(range(1, n + 1))  # end of the symbol that starts at i
    before = list(range(-1, n - 1))
    get = ranks.get
    tree = [none] * (2 * size)
    for i in range(n - 1):
        if (rank := get(piece[i : i + 2])) is not None:
            tree[size + i] = rank << bits | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    place = (1 << bits) - 1
    while (top := tree[1]) != none:
        i = top & place
        j = end[i]
        end[i] = k = end[j]
        changed = []
        if j < n - 1:
            changed.append((j, none))
        if k < n:
            before[k] = i
            rank = get(piece[i : end[k]])
            changed.append((i, none if rank is None else rank << bits | i))
        else:
            changed.append((i, none))
        if (h := before[i]) >= 0:
            rank = get(piece[h:k])
            changed.append((h, none if rank is None else rank << bits | h))
        for at, value in changed:
            at += size
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                if b < a:
                    a = b
                if tree[at] == a:
                    break
                tree[at] = a
                at >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.digits = {v: str(v) for v in self.bytes_of}
        self.cache = Cache(lambda piece: tuple(merge_piece(piece.encode(), self.ranks)))
        self.find = splitter().findall

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, self.find(text)))) if text else []

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(df: DataFrame, path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and the ids of its text."""

    def make():
        c = codec(path)
        return lambda texts: {"ids": [c.encode(x) for x in texts]}

    return map_column(df, [F.col(id_col).cast("bigint").alias("doc_id")], text_of(df, text_col), make, pa.schema([("ids", pa.list_(pa.int32()))]))


def decode(df: DataFrame, path: str, id_col="doc_id", ids_col="ids") -> DataFrame:
    """doc_id and the bytes that its ids stand for; null ids give empty bytes."""

    def make():
        c = codec(path)
        return lambda rows: {"bytes": [c.decode(x or ()) for x in rows]}

    return map_column(df, [F.col(id_col).cast("bigint").alias("doc_id")], F.col(ids_col), make, pa.schema([("bytes", pa.binary())]))


_TOKENS = pa.schema([("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def tokens(df: DataFrame, path: str, id_col="doc_id", text_col="text", keep=()) -> DataFrame:
    """doc_id, the columns in keep, the ids of each text, and digests of the ids and of what they decode to."""

    def make():
        c = codec(path)

        def apply(texts):
            ids = [c.encode(x) for x in texts]
            return {
                "ids": ids,
                "n_tokens": list(map(len, ids)),
                "ids_sha256": [sha256(" ".join(map(c.digits.__getitem__, x)).encode()).hexdigest() for x in ids],
                "decoded_sha256": [sha256(c.decode(x)).hexdigest() for x in ids],
            }

        return apply

    return map_column(df, [F.col(id_col).cast("bigint").alias("doc_id"), *keep], text_of(df, text_col), make, _TOKENS)


_DIGEST = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])


def digest(df: DataFrame, path: str, id_col="doc_id", text_col="text", keep=()) -> DataFrame:
    """Encodes, decodes the ids and digests both in one pass, so that neither ids nor bytes leave the task."""

    def make():
        c = codec(path)

        def apply(texts):
            out = {k: [] for k in _DIGEST.names}
            for x in texts:
                ids = c.encode(x)
                back = c.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha256(" ".join(map(c.digits.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(sha256(back).hexdigest())
                out["round_trip"].append(back == (x or "").encode())
            return out

        return apply

    return map_column(df, [F.col(id_col).cast("bigint").alias("doc_id"), *keep], text_of(df, text_col), make, _DIGEST)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir), default_path())
