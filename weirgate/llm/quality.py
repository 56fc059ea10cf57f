r"""Quality rules with host verdicts: rule failures by host, rates shrunk with an empirical beta prior, verdicts joined back.

1. Each text is measured once, in a pass over all of it; only counts go on.
2. Each soft rule below is judged by itself. Its failures are summed by host (map-side first).
3. Each rule has a beta prior, whose two parameters come from the mean and variance of the hosts' own rates (method of moments
   over all hosts); a host's rate of a rule is (failures + a) / (documents + a + b), so that hosts with few documents lean on
   the prior.
4. A host is bad in a rule if its shrunk rate is above `bad_rate`. A document stays unless it fails the base rule, or it fails
   a soft rule in which its host is bad. So a clean document stays wherever it is.

Defined results: a null or empty text has no words and fails the base rule. A null host takes part in no host verdict:
its documents are judged by the base rule alone. An empty table gives an empty result. Repeated rows are separate
documents. Other columns are ignored, whatever their names. Numbers of a hot host are summed before they are shuffled,
and the join back on the host is left to the adaptive skew join.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_column, saved, text_of

#: Host rates above this make a host bad.
BAD_RATE = 0.5
#: Soft rules: symbols per hundred word characters, percent of repeated-window words, duplicate lines per hundred words, mean word length.
MAX_SYMBOLS, MAX_REPEATS, MAX_DUP_LINES, MIN_MEAN, MAX_MEAN = 5, 20, 2, 2, 12

_SYMBOLS = re.compile(rb"[^#*$%&|<>]+")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three found twice or more."""
    seen: dict[tuple, int] = {}
    hit = bytearray(len(words))
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        if (first := seen.setdefault(window, i)) != i:
            hit[first : first + 3] = hit[i : i + 3] = b"\1\1\1"
    return sum(hit)


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, len(_SYMBOLS.sub(b"", raw)), len(lines) - len(set(lines)), repeated(words)


def measures(df: DataFrame, id_col="doc_id", text_col="text", host_col="source") -> DataFrame:
    """doc_id, host and the counts of each text."""

    def make():
        return lambda texts: dict(zip(_COUNTS, zip(*map(measure, texts)))) if texts else {k: [] for k in _COUNTS}

    keep = [F.col(id_col).cast("bigint").alias("doc_id"), F.col(host_col).cast("string").alias("host")]
    return map_column(df, keep, text_of(df, text_col), make, pa.schema([(k, pa.int64()) for k in _COUNTS]))


#: The soft rules, in order; a text below the base rule's length fails all of them.
RULES = ("symbols", "repeats", "dup_lines", "short_words", "long_words")


def with_rules(counts: DataFrame) -> DataFrame:
    n, chars = F.col("n_words"), F.col("word_chars")
    short = n < 50
    soft = {
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS * chars,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEATS * n,
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINES * n,
        "short_words": chars < MIN_MEAN * n,
        "long_words": chars > MAX_MEAN * n,
    }
    return counts.withColumns({"base_failed": short | (100 * F.col("n_repeat_words") > 50 * n), **{f"failed_{k}": short | soft[k] for k in RULES}})


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """The two parameters of each rule's prior from the hosts' rates: a count and two sums for each rule reach the driver. Without hosts it is flat."""
    # Rates in whole ten-thousandths: the order of their sum doesn't matter.
    rate = lambda k: F.round(F.col(f"failures_{k}") / F.col("host_docs") * 10000).cast("bigint")
    count, *sums = hosts.agg(F.count("*"), *(x for k in RULES for x in (F.sum(rate(k)), F.sum(rate(k) * rate(k))))).first()
    return {k: _prior(count, s1, s2) for k, s1, s2 in zip(RULES, sums[::2], sums[1::2])}


def _prior(k: int, s1: int, s2: int) -> tuple[float, float]:
    if not k:
        return 1.0, 1.0
    mean = min(max(s1 / k / 10000, 0.001), 0.999)
    spread = max(s2 / k / 1e8 - (s1 / k / 10000) * (s1 / k / 10000), 1e-6)
    weight = max(mean * (1 - mean) / spread - 1, 1.0)
    return mean * weight, (1 - mean) * weight


def host_verdicts(ruled: DataFrame, bad_rate=BAD_RATE) -> DataFrame:
    """host, its documents, and for each rule its failures, shrunk rate and verdict."""
    # Written, the hosts have no partitioning of their own: both sides of a join with them are dealt anew, and a hot host is split.
    sums = [F.sum(F.col(f"failed_{k}").cast("bigint")).alias(f"failures_{k}") for k in RULES]
    hosts = saved(ruled.where("host is not null").groupBy("host").agg(F.count("*").alias("host_docs"), *sums))
    out = []
    for k, (a, b) in beta_priors(hosts).items():
        shrunk = (F.col(f"failures_{k}") + a) / (F.col("host_docs") + (a + b))
        out += [f"failures_{k}", shrunk.alias(f"rate_{k}"), (shrunk > bad_rate).alias(f"bad_{k}")]
    return hosts.select("host", "host_docs", *out)


def judge(df: DataFrame, id_col="doc_id", text_col="text", host_col="source", bad_rate=BAD_RATE) -> DataFrame:
    ruled = with_rules(saved(measures(df, id_col, text_col, host_col)))
    joined = ruled.join(host_verdicts(ruled, bad_rate), "host", "left")
    fails = F.lit(False)
    for k in RULES:
        fails = fails | (F.col(f"failed_{k}") & F.coalesce(f"bad_{k}", F.lit(False)))
    return joined.withColumn("kept", ~F.col("base_failed") & ~fails)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", *_COUNTS, "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
pos AS (SELECT rid, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i+1], words[i+2]) AS c FROM pos),
hit AS (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1),
rep AS (SELECT rid, count(*) AS n FROM hit GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM w),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, source AS host, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words < 50 OR 100 * n_symbols > 5 * word_chars AS f1, n_words < 50 OR 100 * n_repeat_words > 20 * n_words AS f2,
    n_words < 50 OR 100 * n_dup_lines > 2 * n_words AS f3, n_words < 50 OR word_chars < 2 * n_words AS f4,
    n_words < 50 OR word_chars > 12 * n_words AS f5, row_number() OVER () AS id FROM m),
f AS (SELECT id, host, unnest([1, 2, 3, 4, 5]) AS rule, unnest([f1, f2, f3, f4, f5]) AS failed FROM r WHERE host IS NOT NULL),
h AS (SELECT host, rule, count(*) AS n, sum(failed::BIGINT)::BIGINT AS f FROM f GROUP BY host, rule),
p AS (SELECT rule, count(*) AS k, sum(round(f / n * 10000)::BIGINT)::DOUBLE AS s1, sum((round(f / n * 10000) * round(f / n * 10000))::BIGINT)::DOUBLE AS s2 FROM h GROUP BY rule),
q AS (SELECT rule, least(greatest(s1 / k / 10000, 0.001), 0.999) AS mean, greatest(s2 / k / 1e8 - (s1 / k / 10000) * (s1 / k / 10000), 1e-6) AS spread FROM p),
b AS (SELECT rule, mean * greatest(mean * (1 - mean) / spread - 1, 1.0) AS a, (1 - mean) * greatest(mean * (1 - mean) / spread - 1, 1.0) AS b FROM q),
v AS (SELECT host, rule FROM h JOIN b USING (rule) WHERE (f + a) / (n + a + b) > 0.5),
gone AS (SELECT DISTINCT id FROM f JOIN v USING (host, rule) WHERE failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (gone.id IS NOT NULL) AS kept
FROM r LEFT JOIN gone USING (id)
"""
