r"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating; a source's target is the smaller of `most` times its
size and the common level times its weight, with the level set so that the targets sum to the whole. A document of a
source is to be taken f = target / size times: floor(f) times for certain, and once more with the fractional part.

Rounding: documents are dealt at random into blocks of about `BLOCK` of one source. In a block, by size, neighbours are
paired, the longest first: expected words move at random from one to the other, without bias, until one of the two is taken
0 or 1 times; the other meets the next. What is left of a block is one document with one fraction; these residuals meet in
the same way in blocks of blocks, up a reduction tree, until a source has one, which is rounded by its own chance. As each
step keeps the sum of expected words, only that last document, mostly a short one, parts the words taken from the target.

Sources may be as many as hosts: they are ranked in ranges side by side, and the level is found by sums over them, of which only
two numbers reach the driver in each round.

Defined results: null texts have size 0; texts of size 0 move no words and are rounded by their own chance. A source without
words has target 0 and takes none. Rows that agree in id, source and text are one unit of several copies, shared out as evenly as
can be; so a repeated row is no hot key: equal rows are counted before they move, and given out in parts. Randomness is a hash of
seed, source, id and text: reruns agree, whatever the partitioning. Null ids are ids like any other. An empty table gives
none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, documents, few, saved

MOST, BLOCK, SEED = 3, 1024, 17
#: Rows that one row is exploded into at once.
PART = 1 << 12
#: Parts of the rows that agree in id, source and text, for their running counts.
PARTS = 256
WEIGHTS = 3
_TINY = 1e-9


def words_in(text):
    text = F.coalesce(text.cast("string"), F.lit(""))
    # Each run of other characters becomes one letter, then only letters are left to count.
    ones = F.regexp_replace(text, f"[^{SPACE_CLASS}]+", "x")
    return F.length(F.regexp_replace(ones, f"[{SPACE_CLASS}]+", "")).cast("bigint")


def sizes(df: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """doc_id, source, words and hash of the text of each row: the text is read once, only for this."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds `rank` from 0, by source, null last. Ranges of sources are sorted side by side; each begins after the rows of those before."""
    row = F.monotonically_increasing_id()
    dealt = saved(sources.orderBy(F.col("source").asc_nulls_last()).withColumns({"range": F.shiftright(row, 33), "place": row.bitwiseAND((1 << 33) - 1)}))
    # One row for each range, so as many as there are partitions.
    ranges = dealt.groupBy("range").agg(F.count("*").alias("n"))
    first = ranges.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("first"))
    return dealt.join(F.broadcast(first), "range").withColumn("rank", F.col("first") + F.col("place")).drop("range", "place", "first")


def level_of(weighted: DataFrame, most: int) -> float:
    """The common level: the sum of min(cap, level * weight) is the sum of all sizes. Each round caps the sources that the last one's level exceeds."""
    total, weights = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return 0.0
    cap, n, level = most * F.col("source_size"), 0, total / weights
    while True:
        k, caps, w = weighted.where(cap < F.lit(level) * F.col("weight")).agg(F.count("*"), F.sum(cap), F.sum("weight")).first()
        if k == n:
            return level
        if w == weights:
            return float("inf")
        n, level = k, (total - caps) / (weights - w)


def targets(units: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, n_units, target: one row for each source."""
    sources = saved(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n_units")))
    weighted = saved(ranked(sources).withColumn("weight", F.col("rank") % WEIGHTS + 1))
    cap = (most * F.col("source_size")).cast("double")
    return weighted.select("source", "source_size", "n_units", F.least(cap, F.lit(level_of(weighted, most)) * F.col("weight")).alias("target"))


def _with(x: str, p: str) -> str:
    return f"named_struct('size', {x}.size, 'doc_id', {x}.doc_id, 'h', {x}.h, 'm', {x}.m, 'copies', {x}.copies, 'p', {p}, 'u', {x}.u)"


def _decided(x: str, more: int) -> str:
    return f"array_append(acc.out, named_struct('size', {x}.size, 'doc_id', {x}.doc_id, 'h', {x}.h, 'm', {x}.m, 'copies', {x}.copies + {more}L))"


def _next(carrier: str, decided: str) -> str:
    return f"named_struct('c', {carrier}, 'out', {decided})"


_UNIT = "struct<size:bigint,doc_id:bigint,h:bigint,m:bigint,copies:bigint,p:double,u:double>"
_DECIDED = "struct<size:bigint,doc_id:bigint,h:bigint,m:bigint,copies:bigint>"
#: Words that can move from x to the carrier, and back, until one of the two is whole.
_UP = "least((1D - acc.c.p) * acc.c.size, x.p * x.size)"
_DOWN = "least(acc.c.p * acc.c.size, (1D - x.p) * x.size)"

#: A block's units in order: the carrier c meets each next unit x, whose uniform u decides which way words move. One of the
#: two becomes whole and is settled; the other carries on with the rest of their mass, so that the expected words stay.
_FOLD = f"""aggregate(units, named_struct('c', CAST(NULL AS {_UNIT}), 'out', CAST(array() AS array<{_DECIDED}>)), (acc, x) -> CASE
  WHEN acc.c IS NULL THEN {_next("x", "acc.out")}
  WHEN x.u * ({_UP} + {_DOWN}) < {_DOWN} THEN CASE
    WHEN (1D - acc.c.p) * acc.c.size <= x.p * x.size THEN {_next(_with("x", f"greatest(x.p - {_UP} / x.size, 0D)"), _decided("acc.c", 1))}
    ELSE {_next(_with("acc.c", f"least(acc.c.p + {_UP} / acc.c.size, 1D)"), _decided("x", 0))} END
  WHEN acc.c.p * acc.c.size <= (1D - x.p) * x.size THEN {_next(_with("x", f"least(x.p + {_DOWN} / x.size, 1D)"), _decided("acc.c", 0))}
  ELSE {_next(_with("acc.c", f"greatest(acc.c.p - {_DOWN} / acc.c.size, 0D)"), _decided("x", 1))} END)"""


def _uniform(*columns, seed: int):
    """In [0, 1), from a hash: the same wherever and whenever it is computed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") / float(1 << 53)


def copies(df: DataFrame, id_col="doc_id", text_col="text", source_col="source", most: int = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per unit: doc_id, source, size, h (hash of the text), m rows, copies taken of all of them together, source_size, target."""
    rows = sizes(df, id_col, text_col, source_col)
    units = saved(rows.groupBy("source", "doc_id", "h").agg(F.min("size").alias("size"), F.count("*").alias("m")))
    goals = saved(targets(units, most))
    who = ("source", "doc_id", "size", "h")
    wish = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0) * F.col("m")
    joined = units.join(goals, units.source.eqNullSafe(goals.source)).drop(goals.source).withColumn("wish", wish)
    whole = F.floor(F.col("wish") + _TINY)
    split = joined.withColumns({"copies": whole, "p": F.greatest(F.col("wish") - whole, F.lit(0.0)), "u": _uniform(*who, seed=seed)})
    empty = F.col("size") == 0
    split = split.withColumn("copies", F.col("copies") + (empty & (F.col("u") < F.col("p"))).cast("bigint")).withColumn("p", F.when(empty, 0.0).otherwise(F.col("p")))
    blocks = F.ceil(F.col("n_units") / block)
    level = split.select("source", F.floor(_uniform(*who, seed=seed + 1) * blocks).cast("bigint").alias("block"), F.struct("size", "doc_id", "h", "m", "copies", "p", "u").alias("unit"))
    most_blocks = goals.agg(F.max(F.ceil(F.col("n_units") / block))).first()[0] or 0
    done = []
    while True:
        level = saved(_reduce(level))
        done.append(level.select("source", F.explode("out").alias("unit")).select("source", "unit.*"))
        left = level.where("c is not null").select("source", F.floor(F.col("block") / block).cast("bigint").alias("block"), F.col("c").alias("unit"))
        if most_blocks <= 1:
            break
        most_blocks = -(-most_blocks // block)
        seed += 1
        level = left.withColumn("unit", F.col("unit").withField("u", _uniform("source", "unit.doc_id", "unit.size", "unit.h", seed=seed + 1)))
    last = left.select("source", "unit.*")
    done.append(last.select("source", "size", "doc_id", "h", "m", (F.col("copies") + (_uniform(*who, seed=seed + 2) < F.col("p")).cast("bigint")).alias("copies")))
    settled = done[0]
    for more in done[1:]:
        settled = settled.unionByName(more)
    return settled.join(goals, settled.source.eqNullSafe(goals.source)).select("doc_id", settled.source, "size", "h", "m", "copies", "source_size", "target")


def _reduce(level: DataFrame) -> DataFrame:
    """One level of the tree: source, block, out (settled units) and c (what is left, or null)."""
    # Source and block are one key, so that a join by source before is no reason to keep a hot source in one task.
    fold = level.groupBy(F.struct("source", "block").alias("at")).agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
    fold = fold.select("at.*", F.expr(f"filter(units, x -> x.p < {_TINY}D)").alias("certain"), F.expr(f"filter(units, x -> x.p >= {_TINY}D)").alias("units"))
    folded = fold.select("source", "block", "certain", F.expr(_FOLD).alias("r"))
    certain = F.expr("transform(certain, x -> named_struct('size', x.size, 'doc_id', x.doc_id, 'h', x.h, 'm', x.m, 'copies', x.copies))")
    return folded.select("source", "block", F.concat(certain, "r.out").alias("out"), F.col("r.c").alias("c"))


def of_rows(units: DataFrame) -> DataFrame:
    """One row per input row again: a unit's copies shared out over its rows, the first ones one more."""
    parts = units.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(m - 1) div {PART}"))))
    dealt = parts.repartition("source", "doc_id", "h", "part")
    k = F.explode(F.sequence(F.col("part") * PART + 1, F.least(F.col("m"), (F.col("part") + 1) * PART)))
    return dealt.withColumn("k", k).withColumn("copies", F.floor(F.col("copies") / F.col("m")) + (F.col("k") <= F.col("copies") % F.col("m")).cast("bigint")).drop("k", "m", "h", "part")


def mixed(df: DataFrame, id_col="doc_id", text_col="text", source_col="source", **settings) -> DataFrame:
    """The input's rows, each as often as the mix takes it."""
    names = df.columns

    def key(ident, source, h):
        return F.struct(ident.isNull().alias("a"), F.coalesce(ident, F.lit(0)).alias("b"), source.isNull().alias("c"), F.coalesce(source, F.lit("")).alias("d"), h.alias("e")).alias("k")

    units = saved(copies(df, id_col, text_col, source_col, **settings).where("copies > 0").select(key(F.col("doc_id"), F.col("source"), F.col("h")), "m", "copies"))
    row = F.struct(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names))).alias("row")
    rows = df.select(key(F.col(id_col).cast("bigint"), F.col(source_col).cast("string"), F.xxhash64(F.col(text_col).cast("string"))), row)
    single = rows.join(units.where("m = 1"), "k").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("again"))
    # Of units of several rows, equal rows are counted first; running counts then say which rows the unit's copies go to.
    equal = rows.join(few(units.where("m > 1")), "k").groupBy(F.struct("k", "m", "copies", "row").alias("g")).agg(F.count("*").alias("n")).select("g.*", "n").withColumn("of", F.pmod(F.xxhash64("row"), F.lit(PARTS)))
    parts = equal.groupBy("k", "of").agg(F.sum("n").alias("n"))
    first = parts.select("k", "of", (F.sum("n").over(Window.partitionBy("k").orderBy("of")) - F.col("n")).alias("first"))
    within = F.sum("n").over(Window.partitionBy("k", "of").orderBy(F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1))
    placed = equal.withColumn("within", F.coalesce(within, F.lit(0))).join(first, ["k", "of"]).withColumn("at", F.col("first") + F.col("within"))
    more = F.greatest(F.lit(0), F.least(F.col("at") + F.col("n"), F.col("copies") % F.col("m")) - F.col("at"))
    often = placed.select("k", "row", (F.floor(F.col("copies") / F.col("m")) * F.col("n") + more).alias("t")).where("t > 0")
    dealt = often.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(t - 1) div {PART}")))).repartition("k", "part")
    several = dealt.select("row", F.explode(F.sequence(F.col("part") * PART + 1, F.least(F.col("t"), (F.col("part") + 1) * PART))).alias("again"))
    return single.unionByName(several).select(*(F.col("row").getField(f"c{i}").alias(n) for i, n in enumerate(names)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of_rows(copies(documents(spark, sf_dir)))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
