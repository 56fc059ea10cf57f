"""Detectors, thresholds, directions: findings of each message as one array column.

A detector pack is a list of rules with a pattern each; our own small pack stands where another can be plugged in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..plans.config import NAMESPACE, SEVERITIES, ScannerConfig


@dataclass(frozen=True)
class Detector:
    type: str
    subtype: str
    severity: str
    pattern: str
    direction: str = "inbound"
    #: A phrase of every match, in lower case: texts without it aren't searched.
    needs: str = ""


# The pack that ships with this package.
PACK = (
    Detector("prompt_injection", "instruction_override", "high", "(?i)ignore (?:all|any|previous) instructions", needs="instructions"),
    Detector("credential", "token", "critical", "token = \"[0-9a-f]{40}\"", needs="token = "),
    Detector("credential", "aws_key", "critical", "AKIA[0-9A-Z]{16}", needs="akia"),
    Detector("personal", "email", "medium", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", needs="@"),
    Detector("personal", "ipv4", "low", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", needs="."),
)
FINDING = "struct<position:int,rule_id:string,type:string,subtype:string,severity:string,rank:int,matched:string,direction:string,blocked:boolean,description:string>"
_BLOCK = 128


def rule_id(kind: Column, subtype: Column) -> Column:
    """namespace.type.subtype with other characters as dots; the types of the rule layers get scanner before them."""
    clean = lambda x: F.regexp_replace(x, "[^a-zA-Z0-9_-]", ".")
    k = clean(kind)
    return F.concat_ws(".", F.lit(NAMESPACE), F.when(k.isin("syntactic", "schema"), F.concat(F.lit("scanner."), k)).otherwise(k), clean(subtype))


def severity_rank(severity: Column) -> Column:
    """1 to 4; an unknown severity counts as critical."""
    out = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES, 1):
        out = F.when(severity == s, i).otherwise(out)
    return out


def starts(gaps: Column, matches: Column) -> Column:
    """Places of a pattern's matches in code points, from the lengths of the pieces around them, summed in two levels."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))

    def running(xs: Column, first: Column) -> Column:
        seed = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, seed, lambda acc, x: F.struct((acc.at + x).alias("at"), F.array_append(acc.out, acc.at).alias("out")), lambda acc: acc.out)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda b: F.slice(steps, b * _BLOCK + 1, _BLOCK))
    sums = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x))
    before = F.flatten(F.zip_with(blocks, running(sums, F.lit(0)), running))
    return F.zip_with(before, F.slice(gaps, 1, F.size(matches)), lambda b, g: b + F.length(g))


def detect(df: DataFrame, config: ScannerConfig = ScannerConfig(), pack: tuple[Detector, ...] = PACK, content="content", out="findings") -> DataFrame:
    """Adds the array of findings of the configured direction, in the order of the pack and then of place."""
    chosen = [d for d in pack if config.direction == "both" or d.direction in (config.direction, "both")]
    limit = SEVERITIES.index(config.threshold) + 1
    df = df.withColumn("__low", F.lower(content))
    for i, d in enumerate(chosen):
        found = F.regexp_extract_all(F.col(content), F.lit(d.pattern), F.lit(0))
        df = df.withColumn("__m", F.when(F.contains("__low", F.lit(d.needs)), found) if d.needs else found)
        df = df.withColumn("__s", F.when(F.size("__m") > 0, starts(F.split(F.col(content), d.pattern, -1), F.col("__m"))))
        rank = SEVERITIES.index(d.severity) + 1 if d.severity in SEVERITIES else len(SEVERITIES)
        direction = "inbound" if d.direction == "both" and config.direction != "outbound" else config.direction if d.direction == "both" else d.direction
        made = F.transform("__m", _finding(d, rank, direction, rank >= limit))
        df = df.withColumn(f"__f{i}", F.when(F.size("__m") > 0, made).otherwise(F.array().cast(f"array<{FINDING}>"))).drop("__m", "__s")
    found = F.concat(*(F.col(f"__f{i}") for i in range(len(chosen)))) if chosen else F.array().cast(f"array<{FINDING}>")
    if config.direction == "both":
        df = df.withColumn("__found", found)
        found = _one_of_both(F.col("__found"))
    return df.withColumn(out, found).drop("__low", "__found", *(f"__f{i}" for i in range(len(chosen))))


def _one_of_both(found: Column) -> Column:
    """One finding for each position and type, as `merge_directions` has it. Texts without two at one place keep their array."""
    place = lambda f: F.struct(f.position.alias("position"), f.type.alias("type"))
    places = F.transform(found, place)
    listed = F.concat(F.filter(found, lambda f: f.direction == "inbound"), F.filter(found, lambda f: f.direction != "inbound"))

    def best(p: Column) -> Column:
        inbound = F.get(F.reverse(F.filter(found, lambda f: (place(f) == p) & (f.direction == "inbound"))), F.lit(0))
        outbound = F.filter(found, lambda f: (place(f) == p) & (f.direction != "inbound"))
        first = F.get(F.filter(outbound, lambda f: f.rank == F.array_max(F.transform(outbound, lambda o: o.rank))), F.lit(0))
        return F.when(inbound.isNull() | (first.rank > inbound.rank), first).otherwise(inbound)

    return F.when(F.size(F.array_distinct(places)) == F.size(places), found).otherwise(F.transform(F.array_distinct(F.transform(listed, place)), best))


def _finding(d: Detector, rank: int, direction: str, blocked: bool):
    ident = rule_id(F.lit(d.type), F.lit(d.subtype))

    def make(m: Column, i: Column) -> Column:
        text = F.concat(F.lit(f'{d.type}/{d.subtype} ({d.severity}): "'), m, F.lit('"'))
        return F.struct(F.col("__s")[i].alias("position"), ident.alias("rule_id"), F.lit(d.type).alias("type"), F.lit(d.subtype).alias("subtype"), F.lit(d.severity).alias("severity"), F.lit(rank).alias("rank"), m.alias("matched"), F.lit(direction).alias("direction"), F.lit(blocked).alias("blocked"), text.alias("description"))

    return make


def blocking(findings: Column) -> Column:
    return F.filter(findings, lambda f: f.blocked)


def safe(findings: Column) -> Column:
    return ~F.exists(findings, lambda f: f.blocked)


def merge_directions(findings: DataFrame, keys: list[str], idx="idx") -> DataFrame:
    """One finding for each key, position and type, out of rows of both directions.

    Within inbound the last wins; an outbound one replaces what is there only with a strictly higher rank, so the first of
    the highest does. The result stands at the place of its key's first row, inbound before outbound.
    """
    rank = severity_rank(F.col("severity"))
    inbound = F.col("direction") == "inbound"
    place = [*keys, "position", "type"]
    # Of the inbound rows the last; of the outbound the first of the highest; then the inbound unless it is outranked.
    ordered = F.struct(F.when(inbound, F.lit(0)).otherwise(rank).alias("r"), F.when(inbound, F.col(idx)).otherwise(-F.col(idx)).alias("i"))
    best = findings.withColumn("__rank", rank).groupBy(*place).agg(
        F.max(F.when(inbound, F.struct(ordered.alias("o"), F.struct(*findings.columns).alias("f"), F.col("__rank").alias("rank")))).alias("a"),
        F.max(F.when(~inbound, F.struct(ordered.alias("o"), F.struct(*findings.columns).alias("f"), F.col("__rank").alias("rank")))).alias("b"),
        F.min(F.struct((~inbound).alias("out"), F.col(idx).alias("i"))).alias("first"),
    )
    won = F.when(F.col("a").isNull() | (F.col("b.rank") > F.col("a.rank")), F.col("b.f")).otherwise(F.col("a.f"))
    return best.select(won.alias("f"), F.col("first.out").alias("__o"), F.col("first.i").alias("__i")).select("f.*", F.struct("__o", "__i").alias("place"))


def findings_table(df: DataFrame, keys: list[str], findings: str = "findings") -> DataFrame:
    """One row per finding."""
    return df.select(*keys, F.posexplode_outer(findings).alias("idx", "f")).where("f is not null").select(*keys, "idx", "f.*")


def scan_and_sanitize(df: DataFrame, config: ScannerConfig = ScannerConfig(), sanitize=None, pack: tuple[Detector, ...] = PACK, content="content") -> DataFrame:
    """Findings and the redacted content of each message; objects are scanned as their JSON text."""
    from ..plans.config import SanitizeConfig
    from .redact import redact

    df = df.withColumn(content, J.stringify(F.col(content), df.schema[content].dataType))
    return redact(detect(df, config, pack, content), sanitize or SanitizeConfig(), content)
