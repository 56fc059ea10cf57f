"""Redaction: ranges of findings, merged and replaced, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hmac_sha256
from ..plans.config import SanitizeConfig
from .scanner import severity_rank, starts

#: Places of one finding that are replaced where its own place doesn't hold it.
FALLBACK = 1000
_RANGE = "struct<start:int,end:int,rank:int,rule_id:string,fallback:boolean>"


def redact(df: DataFrame, config: SanitizeConfig = SanitizeConfig(), content="content", findings="findings", out="sanitized") -> DataFrame:
    """Adds struct(content, redactions, count, removed, original_length, fallback_count, rule_ids).

    Findings are structs with rule_id, matched, position, severity and blocked. Ranges that overlap or touch become one, under
    the rule of the highest severity, the first on ties.
    """
    text = F.col(content)
    chosen = F.filter(findings, lambda f: (F.lit(config.redact_all) | f.blocked) & (F.length(f.matched) > 0))

    def ranges(f: Column) -> Column:
        n = F.length(f.matched)
        there = F.coalesce((f.position >= 0) & (F.substring(text, f.position + 1, n) == f.matched), F.lit(False))
        quoted = F.concat(F.lit(r"\Q"), F.replace(f.matched, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        pieces = F.split(text, quoted, FALLBACK + 1)
        copies = F.array_repeat(f.matched, F.size(pieces) - 1)
        rank = severity_rank(f.severity)
        make = lambda at, fallback: F.struct(at.alias("start"), (at + n).alias("end"), rank.alias("rank"), f.rule_id.alias("rule_id"), F.lit(fallback).alias("fallback"))
        elsewhere = F.when(F.size(pieces) > 1, F.transform(starts(pieces, copies), lambda at: make(at, True))).otherwise(F.array().cast(f"array<{_RANGE}>"))
        return F.when(there, F.array(make(f.position, False))).otherwise(elsewhere)

    df = df.withColumn("__r", F.when(F.size(findings) > 0, F.flatten(F.transform(chosen, ranges))))
    # By start, and in the findings' order where starts are equal.
    numbered = F.transform("__r", lambda r, i: F.struct(r.start.alias("start"), i.alias("i"), r.alias("r")))
    df = df.withColumn("__o", F.transform(F.array_sort(numbered), lambda x: x.r))

    def fold(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last.start.alias("start"), F.greatest(last.end, r.end).alias("end"), F.greatest(last.rank, r.rank).alias("rank"), F.when(r.rank > last.rank, r.rule_id).otherwise(last.rule_id).alias("rule_id"), (last.fallback | r.fallback).alias("fallback"))
        touches = F.when(F.size(acc) > 0, r.start <= last.end).otherwise(False)
        return F.when(touches, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.array_append(acc, r))

    df = df.withColumn("__g", F.aggregate("__o", F.array().cast(f"array<{_RANGE}>"), fold))
    mark = (lambda r: F.concat(F.lit("[REDACTED:"), r.rule_id, F.lit("]"))) if config.include_rule else (lambda r: F.lit(config.placeholder))
    piece = lambda r: F.substring(text, r.start + 1, r.end - r.start)
    digest = (lambda r: hmac_sha256(config.hmac_key, piece(r))) if config.hash_redactions and config.hmac_key else (lambda r: F.lit(""))
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rebuilt = F.aggregate(
        "__g", seed,
        lambda acc, r: F.struct(r.end.alias("at"), F.concat(acc.out, F.array(F.substring(text, acc.at + 1, r.start - acc.at), mark(r))).alias("out")),
        lambda acc: F.concat(F.array_join(acc.out, ""), F.substring(text, acc.at + 1, F.length(text))),
    )
    details = F.transform("__g", lambda r: F.struct(r.start.alias("position"), (r.end - r.start).alias("matched_length"), digest(r).alias("content_hash"), mark(r).alias("replacement"), r.fallback.alias("fallback"), r.rule_id.alias("rule_id")))
    made = F.struct(
        F.when(F.size("__g") > 0, rebuilt).otherwise(text).alias("content"), F.coalesce(details, F.array().cast("array<struct<position:int,matched_length:int,content_hash:string,replacement:string,fallback:boolean,rule_id:string>>")).alias("redactions"),
        F.when(F.col("__g").isNotNull(), F.size("__g")).otherwise(0).alias("count"),
        F.coalesce(F.aggregate("__g", F.lit(0), lambda a, r: a + r.end - r.start), F.lit(0)).alias("removed"), F.length(text).alias("original_length"),
        F.when(F.col("__g").isNotNull(), F.size(F.filter("__g", lambda r: r.fallback))).otherwise(0).alias("fallback_count"),
        F.coalesce(F.array_distinct(F.reverse(F.transform("__g", lambda r: r.rule_id))), F.array().cast("array<string>")).alias("rule_ids"),
    )
    return df.withColumn(out, made).drop("__r", "__o", "__g")
