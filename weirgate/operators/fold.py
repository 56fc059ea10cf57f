"""Ordered folds per key: rows of a key in order, through a pure step function, in bounded memory.

Rows are dealt by key and sorted inside their partition; each batch is folded as it comes, so a hot key streams through one
task and is never gathered. The step functions are plain Python and serve batch, streaming and tests alike.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))


def keyed_fold(df: DataFrame, keys: list[str], order: list[str], step: Callable[[object, dict], tuple[object, dict | None]], out: list[tuple[str, pa.DataType, str]], keep: list[str]) -> DataFrame:
    """`step(state, row) -> (state, outputs)` over the rows of each key, state None at its start; no keys: one order over all rows.

    Returns the columns in keep and the outputs, one row for each input row whose outputs aren't None. Arrays and structs can
    be kept, but the step doesn't see them.
    """
    importable(df.sparkSession)
    dealt = df.repartition(*keys) if keys else df.repartition(1)
    ordered = dealt.sortWithinPartitions(*keys, *order)
    types = dict(df.dtypes)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: object = None
        now: object = ()
        for batch in batches:
            rows = batch.select([f.name for f in batch.schema if not pa.types.is_nested(f.type)]).to_pylist()
            made: list[dict] = []
            kept: list[int] = []
            for i, row in enumerate(rows):
                if (k := tuple(row[x] for x in keys)) != now:
                    state, now = None, k
                state, result = step(state, row)
                if result is not None:
                    kept.append(i)
                    made.append(result)
            taken = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(names.index(x)) for x in keep] + [pa.array([r[n] for r in made], t) for n, t, _ in out], names=[*keep, *(n for n, _, _ in out)])

    return ordered.mapInArrow(run, ", ".join([f"`{x}` {types[x]}" for x in keep] + [f"`{n}` {sql}" for n, _, sql in out]))
