"""SimHash near-duplicates: fingerprints, one BK-tree for each shard, connected components.

Fingerprints link at `radius` or fewer differing bits. Cut into radius + s blocks of bits, two linked fingerprints agree on at
least s of them, so every choice of s blocks, with their bits, names a shard, and each link lies inside some shard. s grows
with the number of distinct fingerprints, so that shards stay small on average. A shard with more than `CROWD` fingerprints is
named more closely: the bits outside its s blocks are cut into radius + 1 blocks, of which two linked fingerprints agree on
at least one, so each of these, with its bits, names a smaller shard, and again no link is lost.

A shard is one task's run of sorted rows. Its distinct fingerprints go one after the other into one BK-tree, children keyed by
their Hamming distance to the parent. Before a fingerprint is added, it is searched: only edges within the radius of its
own distance are followed, and each hit joins it to the hit's component (union-find). A subtree that lies wholly in a
component already joined is not entered, so thousands of near copies cost about one descent for each instead of all their
pairs, and only the links to each component's first member leave the task. Trees travel to their queries through the
shuffle rather than by broadcast, since the fingerprints of a large corpus have no size bound.

Components are found by large-star and small-star steps on the links, each step written to the shared folder, until
nothing changes. A node is a fingerprint with the smallest id it occurs with, so that the smallest node of a component holds
the component's id and no join on the component is needed. Minima are written before they are joined, so that both sides of
every join are dealt anew and a hot node is split by the adaptive skew join. Only counts reach the driver.

Defined results: null and word-free texts have fingerprint zero and link like any other; fewer than four words make one
shingle. Exact copies share a fingerprint and are folded into one before any search. A component's id is its smallest
non-null doc_id (null if it has none). Repeated rows give repeated results; an empty table gives none. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, few, importable, map_column, saved, text_of

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Mean distinct fingerprints of a shard, above which shards are named by one more block.
SHARD = 64
#: Distinct fingerprints of a single shard above which it is named by a further block.
CROWD = 2048
_PART = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64)
    ones = sum(np.unpackbits(hashes[i : i + _PART].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for i in range(0, len(hashes), _PART))
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


class BKTree:
    """Integers under Hamming distance; children are keyed by their distance to the parent.

    `pure` holds for each node the component of its whole subtree (of the tree's union-find), or -1 where there are several.
    """

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.above: list[int] = []  # union-find over nodes
        self.pure: list[int] = []
        self.visits = 0

    def find(self, x: int) -> int:
        above = self.above
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Nodes within the radius, by the triangle inequality only along edges from d - radius to d + radius."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            self.visits += 1
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                yield at
            stack += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]

    def join(self, value: int, radius: int) -> int:
        """Adds a value that isn't there yet, joined to the components of all values within the radius. Its search is that of `near`, without subtrees that hold nothing new."""
        values, children, pure, above = self.values, self.children, self.pure, self.above
        new = home = len(values)
        above.append(new)
        stack = [0] if values else []
        while stack:
            at = stack.pop()
            if home != new and pure[at] >= 0 and self.find(pure[at]) == home:
                continue
            self.visits += 1
            d = (value ^ values[at]).bit_count()
            if d <= radius and (other := self.find(at)) != home:
                home, less = min(other, home), max(other, home)
                above[less] = home
            if children[at]:
                low, high = d - radius, d + radius
                stack += [child for edge, child in children[at].items() if low <= edge <= high]
        values.append(value)
        children.append({})
        pure.append(home)
        at = 0
        while at != new:
            if pure[at] >= 0 and self.find(pure[at]) != home:
                pure[at] = -1
            at = children[at].setdefault((value ^ values[at]).bit_count(), new)
        return new


def shard_links_of(values: list[int], radius: int) -> tuple[list[int], list[int]]:
    """For distinct non-negative values, links (a, b) of each to the first value of its component, if that is another one."""
    tree = BKTree()
    for v in values:
        tree.join(v, radius)
    a, b = [], []
    for i in range(len(values)):
        if (first := tree.find(i)) != i:
            a.append(values[i])
            b.append(values[first])
    return a, b


def shard_plan(distinct: int, radius: int = RADIUS, shard: int = SHARD) -> tuple[list[tuple[int, int]], int]:
    """Blocks (shift, width) and how many of them name a shard: the fewest whose bits keep shards near `shard` on average."""
    for s in range(1, 5):
        n = radius + s
        edges = [64 * i // n for i in range(n + 1)]
        if distinct <= shard << 64 * s // n or s == 4:
            return [(a, b - a) for a, b in zip(edges, edges[1:])], s
    raise AssertionError


def _bits(shift: int, width: int):
    return F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1)


def _finer(rest: list[tuple[int, int]], radius: int):
    """The further names of a crowded shard: the bits of the blocks in `rest`, cut into radius + 1 runs."""
    places = [shift + k for shift, width in rest for k in range(width)]
    edges = [len(places) * i // (radius + 1) for i in range(radius + 2)]
    names = []
    for number, (lo, hi) in enumerate(zip(edges, edges[1:])):
        name, at = F.lit(number).cast("bigint"), lo
        while at < hi:  # runs of neighbouring bits are taken at once
            end = at + 1
            while end < hi and places[end] == places[end - 1] + 1:
                end += 1
            name = F.shiftleft(name, end - at).bitwiseOR(_bits(places[at], end - at))
            at = end
        names.append(name)
    return F.array(*names)


def shards(prints: DataFrame, radius: int = RADIUS, crowd: int | None = None) -> DataFrame:
    """shard, fine, fp: every distinct fingerprint `fp` under each of its shards' names, crowded shards under finer names."""
    blocks, s = shard_plan(prints.count(), radius)
    choices = list(combinations(range(len(blocks)), s))
    names = []
    for number, chosen in enumerate(choices):
        name = F.lit(number).cast("bigint")
        for k in chosen:
            name = F.shiftleft(name, blocks[k][1]).bitwiseOR(_bits(*blocks[k]))
        names.append(F.struct(F.lit(number).alias("choice"), name.alias("shard")))
    named = prints.select(F.explode(F.array(*names)).alias("n"), "fp").select("n.choice", "n.shard", "fp")
    crowded = saved(named.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > (CROWD if crowd is None else crowd)).select("shard", F.lit(True).alias("crowded")))
    finer = [_finer([b for k, b in enumerate(blocks) if k not in chosen], radius) for chosen in choices]
    fine = F.when(F.col("crowded"), F.element_at(F.array(*finer), F.col("choice") + 1)).otherwise(F.array(F.lit(-1).cast("bigint")))
    return named.join(crowded, "shard", "left").select("shard", F.explode(fine).alias("fine"), "fp")


def shard_links(prints: DataFrame, radius: int = RADIUS, crowd: int | None = None) -> DataFrame:
    """Links (a, b), b the first of a's component inside some shard, from distinct fingerprints `fp`."""
    key = ["shard", "fine"]
    dealt = shards(prints, radius, crowd).repartition(*key).sortWithinPartitions(*key, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(shard: np.ndarray, fine: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(fine) != 0)) + 1
            starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(shard)]))
            a: list[int] = []
            b: list[int] = []
            for i in np.flatnonzero(ends - starts > 1).tolist():
                more = shard_links_of(fps[starts[i] : ends[i]].view(np.uint64).tolist(), radius)
                a += more[0]
                b += more[1]
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays([signed(a), signed(b)], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []  # of the shard that may go on in the next batch
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(columns[0]):
                continue
            last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
            cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0
            if cut or (held and (held[0][0][0], held[0][1][0]) != (columns[0][-1], columns[1][-1])):
                held.append(tuple(c[:cut] for c in columns))
                yield links(*(np.concatenate(x) for x in zip(*held)))
                held = []
            held.append(tuple(c[cut:] for c in columns))
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    importable(prints.sparkSession)
    return dealt.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node that has a link (a, b) to another. Nodes may be of any type with an order."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).where("m < u"))
        # Where a node is smaller than all its neighbours, its links stay as they are: (v, u). The rest move to the minimum.
        moved = both.where("v > u").join(least, "u", "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
        large = saved(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        small_least = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = saved(small.union(small_least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        state = now


def near_duplicates(df: DataFrame, id_col="doc_id", text_col="text", radius: int = RADIUS, keep=()) -> DataFrame:
    """doc_id, the columns in keep, fp (signed), component_id and root (the fp of the component's smallest node), one row per input row."""
    made = map_column(df, [F.col(id_col).cast("bigint").alias("doc_id"), *keep], text_of(df, text_col), lambda: lambda texts: {"fp": list(map(fingerprint, texts))}, pa.schema([("fp", pa.int64())]))
    rows = saved(made)
    least = F.min("doc_id")
    # Nulls come last: a node is (no id, smallest id, fingerprint).
    node = F.struct(least.isNull().alias("none"), F.coalesce(least, F.lit(0)).alias("id"), F.col("fp").alias("fp"))
    prints = saved(rows.groupBy("fp").agg(node.alias("node")))
    links = saved(shard_links(prints.select("fp"), radius))
    as_nodes = links.join(prints.select(F.col("fp").alias("a"), F.col("node").alias("na")), "a").join(prints.select(F.col("fp").alias("b"), F.col("node").alias("nb")), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    roots = components(as_nodes)
    rooted = saved(prints.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root")))
    return rows.join(rooted, "fp").withColumn("component_id", F.when(~F.col("root.none"), F.col("root.id"))).withColumn("root", F.col("root.fp"))


def one_of_each(df: DataFrame, id_col="doc_id", text_col="text", radius: int = RADIUS) -> DataFrame:
    """The input's rows, one of each component: that with the smallest id (null last, then by the text's hash)."""
    names = df.columns
    ident = F.col(id_col).cast("bigint")
    key = F.struct(ident.isNull().alias("n"), F.coalesce(ident, F.lit(0)).alias("i"), F.xxhash64(text_of(df, text_col)).alias("h"))
    found = near_duplicates(df, id_col, text_col, radius, keep=[key.alias("k")])
    # How many rows have the key is counted in narrow rows: only keys of several rows need folding, and their rows may be many.
    counted = found.groupBy("root", "k").agg(F.count("*").alias("n"))
    kept = saved(counted.groupBy("root").agg(F.min(F.struct("k", "n")).alias("m")).select("m.k", "m.n"))
    rows = df.select(key.alias("k"), F.struct(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names))).alias("row"))
    single = rows.join(kept.where("n = 1").select("k"), "k", "left_semi").select("row")
    # Equal keys are grouped by their text, which the join isn't dealt by, so rows are folded before they move.
    several = rows.join(few(kept.where("n > 1").select("k")), "k", "left_semi").groupBy(F.to_json("k").alias("g")).agg(F.min("row").alias("row")).select("row")
    return single.unionByName(several).select(*(F.col("row").getField(f"c{i}").alias(n) for i, n in enumerate(names)))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
