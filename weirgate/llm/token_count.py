"""Token counts by heap-and-linked-list merging: symbols at the start minus merges made, without any ids.

Symbols of a piece form a doubly linked list; a heap holds candidate pairs by (rank, position). Popping the lowest
valid pair joins its right symbol into the left one and pushes the two new neighbours. A popped pair is stale if either
symbol has changed since it was pushed.

Defined results: null counts as the empty text (0 bytes, 0 tokens). Special strings inside a text count as one token
each and split it, as the library does by default. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_column, text_of
from .pieces import Cache, splitter

LIMIT = 512


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: itself where it prints, else from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def count_piece(piece: bytes, letters: list[str], merges: dict[tuple[str, str], int]) -> int:
    symbol: list[str | None] = [letters[b] for b in piece]
    n = len(symbol)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(rank, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (rank := merges.get((symbol[i], symbol[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or symbol[i] != a or symbol[j] != b:
            continue
        symbol[i], symbol[j] = a + b, None
        after[i] = k = after[j]
        left -= 1
        if k >= 0:
            before[k] = i
            if (rank := merges.get((symbol[i], symbol[k]))) is not None:
                heapq.heappush(heap, (rank, i, symbol[i], symbol[k]))
        if (h := before[i]) >= 0 and (rank := merges.get((symbol[h], symbol[i]))) is not None:
            heapq.heappush(heap, (rank, h, symbol[h], symbol[i]))
    return left


class Counter:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (tuple(x.split(" ", 1)) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"])
        merges = {p: i for i, p in enumerate(pairs)}
        letters = byte_letters()
        added = [re.escape(x["content"]) for x in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(sorted(added, key=len, reverse=True))) if added else None
        self.cache = Cache(lambda piece: count_piece(piece.encode(), letters, merges))
        self.find = splitter().findall

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.cache.__getitem__, self.find(x))) for x in parts)


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(df: DataFrame, path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, UTF-8 bytes and tokens of each text."""

    def make():
        c = counter(path)
        return lambda texts: {"n_bytes": [len((x or "").encode()) for x in texts], "n_tokens": [c.count(x) for x in texts]}

    return map_column(df, [F.col(id_col).cast("bigint").alias("doc_id")], text_of(df, text_col), make, pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64())]))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), default_path()).withColumn("over_limit", F.col("n_tokens") > LIMIT)
