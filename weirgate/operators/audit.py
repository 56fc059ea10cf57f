"""Audit events as a projection of inspection results, in the order in which a message emits them.

Of what was removed from a text an event holds places, lengths and keyed hashes, never the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import VERBOSITIES, AuditConfig, Profile, resolve_profile

# The least verbosity at which each event is emitted.
LEAST = {
    "scan_block": 0, "syntactic_fail": 0, "frequency_escalation_tier1": 0, "frequency_escalation_tier2": 0, "frequency_escalation_tier3": 0,
    "profile_loaded": 0, "audit_config_loaded": 0, "schema_fail": 0, "tool_policy_block": 0, "write_failed": 0,
    "scan_pass": 1, "syntactic_pass": 1, "schema_pass": 1, "syntactic_flags": 1, "flags_summary": 1, "content_sanitized": 1,
    "rule_triggered": 2, "output_diff": 2, "tool_policy_allow": 2, "raw_input_captured": 3, "raw_output_captured": 3,
}

_FIELDS = (("event", "string"), ("pass", "boolean"), ("rule_ids", "array<string>"), ("rule_id", "string"), ("category", "string"), ("severity", "string"), ("score", "double"), ("count", "int"), ("trusted", "boolean"), ("flags", "array<string>"), ("violations", "array<string>"), ("blocking_count", "int"), ("blocked", "boolean"), ("previous_score", "double"), ("terminated", "boolean"), ("characters_removed", "int"),
           ("removals", "array<struct<rule_id:string,position:int,matched_length:int,content_hash:string,fallback:boolean>>"), ("replacements", "array<struct<rule_id:string,length_before:int,length_after:int,fallback:boolean>>"), ("content", "string"), ("length", "int"), ("sha256", "string"), ("stage", "string"))


def _event(name: Column | str, **values: Column) -> Column:
    values["event"] = F.lit(name) if isinstance(name, str) else name
    return F.struct(*((values[f].cast(t) if f in values else F.lit(None).cast(t)).alias(f) for f, t in _FIELDS))


def gate(config: AuditConfig) -> frozenset[str]:
    """The events that go out: a clean pass always does while alerting is on; a summary gives way to its single rules."""
    if not config.enabled:
        return frozenset()
    level = VERBOSITIES.index(config.verbosity)
    return frozenset(e for e, least in LEAST.items() if (least <= level or (config.alerting and e == "syntactic_pass")) and not (e == "flags_summary" and level >= 2))


def emitted(event: Column, config: AuditConfig) -> Column:
    names = gate(config)
    return event.isin(*sorted(names)) if names else F.lit(False)


def category(rule: Column) -> Column:
    return F.regexp_replace(rule, r"\.[^.]*$", "")


def _tier_event(n: int) -> Column:
    return F.when(F.col(f"tier{n}") != "none", _event(F.concat(F.lit("frequency_escalation_"), F.col(f"tier{n}")), score=F.col(f"score{n}"), previous_score=F.col(f"previous{n}"), terminated=F.col(f"tier{n}") == "tier3"))


def all_events(results: DataFrame, only: frozenset[str] = frozenset(LEAST)) -> DataFrame:
    """The events of every message whose names are in `only`: session_id, ts_ms, seq, message_id, tool_call_id, place, and the fields.

    What isn't asked for isn't built, so no content is copied or hashed for it. Tier events of a session's tier are
    emitted once, as its tier rises; while terminated, each time, which doesn't count as a rise.
    """
    pre, found, clean = F.col("pre"), F.col("findings"), F.col("sanitized")
    rules = pre.rule_ids
    none = F.array().cast("array<string>")
    syntactic = F.when(~pre["pass"], "syntactic_fail").when(F.size(rules) > 0, "syntactic_flags").otherwise("syntactic_pass")
    severity = F.when(pre["pass"], "flag").otherwise("block")
    scan_rules = F.array_distinct(F.transform(found, lambda f: f.rule_id))
    safe = ~F.exists(found, lambda f: f.blocked)
    reached, redacted = F.col("path").isin("full", "gated"), clean.isNotNull() & (clean["count"] > 0)
    tiers = ("frequency_escalation_tier1", "frequency_escalation_tier2", "frequency_escalation_tier3")

    def one(names: tuple[str, ...], make) -> list[Column]:
        """An array of the event, or of none if it is null; nothing if no such event is wanted."""
        return [F.array_compact(F.array(make()))] if only.intersection(names) else []

    def each(names: tuple[str, ...], xs: Column, make) -> list[Column]:
        return [F.transform(F.coalesce(xs, none), make)] if only.intersection(names) else []

    parts = [
        *one(tiers, lambda: F.when(F.col("path") == "terminated", _event("frequency_escalation_tier3", score=F.col("score1"), previous_score=F.col("previous1"), terminated=F.lit(True)))),
        *one(("syntactic_fail", "syntactic_flags", "syntactic_pass"), lambda: F.when(pre.isNotNull(), _event(syntactic, **{"pass": pre["pass"]}, rule_ids=rules, flags=pre["flags"], stage=F.lit("syntactic")))),
        *each(("rule_triggered",), rules, lambda r: _event("rule_triggered", rule_id=r, category=category(r), severity=severity, stage=F.lit("syntactic"))),
        *one(("flags_summary",), lambda: F.when(F.size(rules) > 0, _event("flags_summary", rule_ids=rules, count=F.size(rules), blocked=~pre["pass"], stage=F.lit("syntactic")))),
        *one(tiers, lambda: _tier_event(1)),
        *one(("schema_pass", "schema_fail"), lambda: F.when(F.col("schema").isNotNull(), _event(F.when(F.col("schema.pass"), "schema_pass").otherwise("schema_fail"), **{"pass": F.col("schema.pass")}, rule_ids=F.col("schema.rule_ids"), violations=F.col("schema.violations"), trusted=F.col("trusted")))),
        *one(("scan_pass", "scan_block"), lambda: F.when(F.col("path") == "trusted", _event("scan_pass", **{"pass": F.lit(True)}, count=F.lit(0), blocking_count=F.lit(0))).when(found.isNotNull(), _event(F.when(safe, "scan_pass").otherwise("scan_block"), **{"pass": safe}, rule_ids=scan_rules, count=F.size(found), blocking_count=F.size(F.filter(found, lambda f: f.blocked))))),
        *each(("rule_triggered",), scan_rules, lambda r: _event("rule_triggered", rule_id=r, category=category(r), severity=F.when(F.element_at(F.filter(found, lambda f: f.rule_id == r), -1).blocked, "block").otherwise("flag"), stage=F.lit("scanner"))),
        *one(("flags_summary",), lambda: F.when(F.size(found) > 0, _event("flags_summary", rule_ids=scan_rules, count=F.size(found), blocked=~safe, stage=F.lit("scanner")))),
        *one(tiers, lambda: _tier_event(2)),
        *one(("content_sanitized",), lambda: F.when(redacted, _event("content_sanitized", rule_ids=clean.rule_ids, count=clean["count"], characters_removed=clean.removed))),
        *one(("output_diff",), lambda: F.when(redacted, _event("output_diff", removals=F.transform(clean.redactions, lambda r: F.struct(r.rule_id, r.position, r.matched_length, r.content_hash, r.fallback)), replacements=F.transform(clean.redactions, lambda r: F.struct(r.rule_id, r.matched_length, F.length(r.replacement), r.fallback))))),
        *one(("raw_input_captured",), lambda: F.when(reached, _event("raw_input_captured", content=F.col("content"), length=F.length("content"), sha256=F.sha2("content", 256)))),
        *one(("raw_output_captured",), lambda: F.when(reached & clean.isNotNull(), _event("raw_output_captured", content=clean.content, length=F.length(clean.content), sha256=F.sha2(clean.content, 256)))),
    ]
    listed = F.concat(*(F.coalesce(p, F.array().cast(_TYPE)) for p in parts)) if parts else F.array().cast(_TYPE)
    base = [c for c in ("session_id", "side", "ts_ms", "seq", "message_id", "tool_call_id", "server_name", "tool_name", "agent_id") if c in results.columns]
    # The outer form keeps the optimiser from computing the whole list once more to see whether it is empty.
    made = results.select(*base, (F.col("path") == "terminated").alias("__ended"), F.posexplode_outer(listed).alias("place", "e")).where("place is not null").select(*base, "place", "__ended", "e.*").where(F.col("event").isin(*sorted(only)) if only else F.lit(False))
    return _fresh(made, tiers).drop("__ended") if only.intersection(tiers) else made.drop("__ended")


def _fresh(made: DataFrame, tiers: tuple[str, ...]) -> DataFrame:
    from pyspark.sql import Window

    level = F.coalesce(*(F.when(F.col("event") == e, n) for n, e in enumerate(tiers, 1)))
    rows = made.withColumn("__level", level)
    before = Window.partitionBy(*(c for c in ("session_id", "side") if c in made.columns)).orderBy("ts_ms", "seq", "place").rowsBetween(Window.unboundedPreceding, -1)
    # Only tier events are put in order; all others go out as they are.
    rising = rows.where("__level is not null").withColumn("__high", F.coalesce(F.max(F.when(~F.col("__ended"), F.col("__level"))).over(before), F.lit(0))).where("__ended or __level > __high").drop("__high")
    return rows.where("__level is null").unionByName(rising).drop("__level")


_TYPE = "array<struct<" + ",".join(f"{f}:{t}" for f, t in _FIELDS) + ">>"


def events(results: DataFrame, config: AuditConfig, only: frozenset[str] = frozenset(LEAST)) -> DataFrame:
    """Events that pass the gate, and of these those in `only`; the rest are not built."""
    return all_events(results, gate(config) & only)


def stats(results: DataFrame, config: AuditConfig) -> DataFrame:
    """Per event: how many were emitted and how many the gate dropped. Contents aren't needed for it."""
    if "content" not in results.columns:
        results = results.withColumn("content", F.lit(None).cast("string"))
    passed = emitted(F.col("event"), config)
    return all_events(results).groupBy("event").agg(F.count_if(passed).alias("emitted"), F.count_if(~passed).alias("dropped"))


def construction_events(spark, profile: str | Profile, config: AuditConfig) -> DataFrame:
    """The events of a run's start, of session __init__: the profile with what it changes, and the audit's own settings."""
    p = resolve_profile(profile) if isinstance(profile, str) else profile
    empty = F.array().cast("array<string>")
    suppressed = F.array(*map(F.lit, p.suppress)) if p.suppress else empty
    overrides = F.create_map(*(F.lit(x) for pair in p.weights for x in pair)) if p.weights else F.create_map().cast("map<string,double>")
    loaded = F.struct(F.lit("profile_loaded").alias("event"), F.lit(p.name).alias("detail"), suppressed.alias("suppressed_rules"), overrides.alias("frequency_overrides"), F.lit(None).cast("boolean").alias("enabled"))
    audit = F.struct(F.lit("audit_config_loaded").alias("event"), F.lit(config.verbosity).alias("detail"), empty.alias("suppressed_rules"), F.create_map().cast("map<string,double>").alias("frequency_overrides"), F.lit(config.enabled).alias("enabled"))
    return spark.range(1).select(F.lit("__init__").alias("session_id"), F.inline(F.array(loaded, audit))).where(emitted(F.col("event"), config))


def run_events(results: DataFrame, config: AuditConfig, profile: str | Profile = "general") -> DataFrame:
    """The events of a run's start, at place -1, then those of its messages."""
    start = construction_events(results.sparkSession, profile, config).withColumn("place", F.lit(-1))
    return start.unionByName(events(results, config), allowMissingColumns=True)
