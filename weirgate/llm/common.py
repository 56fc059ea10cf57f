"""What the operators of this subpackage share: Arrow mapping over texts and materialising in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once inside a task, so that a batch of very long texts keeps the worker's memory small.
SLICE_ROWS = 256

#: White space of every word rule here: U+0020 and U+0009 to U+000D, which is what bytes.split() cuts at.
SPACE_CLASS = r"\x20\x09-\x0D"


#: A table of at most so many bytes in fewer files than the cluster has cores is dealt out to all of them.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """The same rows on all cores, where a few small files would keep most of them idle; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(size) <= SPREAD_BYTES and len(df.inputFiles()) < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def importable(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it (as well as in what --py-files has brought)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))


def map_column(df: DataFrame, keep: list, value, make: Callable[[], Callable], schema: pa.Schema) -> DataFrame:
    """Applies a Python function to one column, slice by slice, carrying the `keep` columns unchanged.

    `make()` runs once in each task and returns a function from a list of values (None for null) to a dict of
    lists, one for each field of `schema`. Only the named columns reach Python. `value` is a column, or the number of one
    of the columns in `keep`, which then isn't sent twice.
    """
    importable(df.sparkSession)
    narrow = df.select(*keep) if isinstance(value, int) else df.select(*keep, value.alias("__value"))
    head = [f.name for f in narrow.schema.fields[: len(keep)]]
    place = value if isinstance(value, int) else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = f(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(head))] + [pa.array(made[x.name], x.type) for x in schema],
                    names=head + schema.names,
                )

    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[: len(keep)]] + [f"`{x.name}` {_SQL[x.type]}" for x in schema])
    return narrow.mapInArrow(run, out)


_SQL = {pa.int64(): "bigint", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.int32()): "array<int>", pa.list_(pa.string()): "array<string>", pa.int32(): "int"}


def text_of(df: DataFrame, name: str):
    return F.col(name).cast("string")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir. Where it is unset, a local master (tests) gets a temporary
    folder; any other is refused, as its executors would each write to a disk of their own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Rows of a narrow table up to which it is broadcast.
FEW = 50_000


def few(df: DataFrame) -> DataFrame:
    """A saved, narrow table, to be broadcast if it has at most FEW rows: counted first, so that a larger one is shuffled."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes what is under a path of the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder: later readers neither recompute them nor need the executors that made them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
