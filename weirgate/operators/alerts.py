"""Alerts over audit events: candidates by window functions, then dedup and rate limits in one order over the few candidates.

Counts over sliding windows are dealt by event and time slot, each instant's count going to its own slot and as context to the
next, so that one busy event type is spread over time rather than gathered.
"""

from __future__ import annotations

from collections import OrderedDict, deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import AlertConfig
from .fold import keyed_fold

#: Entries of an event's index, beyond which counts don't grow.
INDEX = 1000
_ALERT = ("alert_rule", "severity", "summary", "score")


def malformed(events: DataFrame) -> Column:
    """Why a row can't be judged, null where it can: a row without event, time or place, or with a score that is no number."""
    bad = F.when(F.col("event").isNull(), "event").when(F.col("ts_ms").isNull(), "ts_ms").when(F.col("seq").isNull(), "seq")
    return bad.when(F.isnan("score"), "score") if "score" in events.columns else bad


def quarantine(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that can be judged, the others with malformed, the reason). No row stops the rest."""
    marked = events.withColumn("malformed", malformed(events))
    return marked.where("malformed is null").drop("malformed"), marked.where("malformed is not null")


def cleared(events: DataFrame, at_ms: list[int]) -> DataFrame:
    """Adds epoch, the number of the given times that are over. All state of alerts starts anew with each."""
    return events.withColumn("epoch", sum(((F.col("ts_ms") >= t).cast("int") for t in at_ms), F.lit(0)))


def _epoch(rows: DataFrame) -> list[str]:
    return [c for c in ("epoch",) if c in rows.columns]


def sliding_count(events: DataFrame, window_ms: int, keys: tuple[str, ...] = ("event",)) -> DataFrame:
    """Adds recent: rows of the same keys, this and earlier ones (by ts_ms, then seq), younger than window_ms.

    Rows are counted by instant first, so that what is ordered in a slot grows with its instants, not with its rows.
    """
    keys = (*keys, *_epoch(events))
    slot = F.floor(F.col("ts_ms") / window_ms)
    instants = events.groupBy(*keys, "ts_ms").agg(F.count("*").alias("__n")).withColumn("__slot", F.explode(F.array(slot, slot + 1)))
    w = Window.partitionBy(*keys, "__slot").orderBy("ts_ms").rangeBetween(-(window_ms - 1), -1)
    earlier = instants.withColumn("__earlier", F.coalesce(F.sum("__n").over(w), F.lit(0))).where(slot == F.col("__slot")).drop("__slot", "__n")
    peers = Window.partitionBy(*keys, "ts_ms").orderBy("seq")
    ranked = events.withColumn("__rank", F.row_number().over(peers))
    return ranked.join(earlier, [*keys, "ts_ms"]).withColumn("recent", F.least(F.col("__earlier") + F.col("__rank"), F.lit(INDEX))).drop("__earlier", "__rank")


def runs(rows: DataFrame, pause_ms: int) -> DataFrame:
    """Adds __run: rows of different runs are more than pause_ms apart, so that a state that fades in that time starts anew.

    Only the distinct time slots, which grow with the time covered, are put in one order.
    """
    slot = F.floor(F.col("ts_ms") / pause_ms)
    slots = rows.select(slot.alias("__at")).distinct()
    w = Window.orderBy("__at")
    starts = (F.col("__at") - F.lag("__at").over(w) > 1).cast("int")
    numbered = slots.withColumn("__run", F.sum(F.coalesce(starts, F.lit(0))).over(w))
    return rows.withColumn("__at", slot).join(numbered, "__at").drop("__at")


def _burst(events: DataFrame, event: str, rule: str, count: int, minutes: int, severity: str, summary) -> DataFrame:
    counted = sliding_count(events.where(F.col("event") == event), minutes * 60_000).where(F.col("recent") >= count)
    return counted.select("*", F.lit(rule).alias("alert_rule"), F.lit(severity).alias("severity"), summary(F.col("recent")).alias("summary"), F.lit(None).cast("double").alias("__score")).drop("recent")


def candidates(events: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """Rows that call for an alert before dedup. events: event, ts_ms, seq, session_id, message_id, tool_call_id, rule_ids, score, trusted, server_name, tool_name, and epoch where states were cleared. Malformed rows call for none."""
    events = quarantine(events)[0]
    null = F.lit(None).cast("double")
    text = lambda before, after: lambda n: F.concat(F.lit(before), n.cast("string"), F.lit(after))
    out = _burst(events, "syntactic_fail", "syntacticFailBurst", config.burst_count, config.burst_minutes, "medium", text("", f" syntactic failures in {config.burst_minutes} minutes across sessions"))
    out = out.unionByName(_burst(events, "write_failed", "writeFailSpike", config.write_count, config.write_minutes, "medium", text("", f" write failures in {config.write_minutes} minutes")))
    out = out.unionByName(_burst(events, "tool_policy_block", "toolPolicyBlock", config.policy_count, config.policy_minutes, "high", text("Tool call blocked by policy guard (", f" in {config.policy_minutes} minutes)")))
    score = F.format_string("%.1f", F.col("score"))
    tiers = events.where(F.col("event").isin("frequency_escalation_tier3", *(["frequency_escalation_tier2"] if config.tier2_enabled else [])))
    third = F.col("event") == "frequency_escalation_tier3"
    out = out.unionByName(tiers.select("*", F.when(third, "frequencyEscalationTier3").otherwise("frequencyEscalationTier2").alias("alert_rule"), F.when(third, "critical").otherwise("high").alias("severity"), F.when(third, F.concat(F.lit("Session terminated — suspicion score "), score, F.lit(" exceeded tier3 threshold"))).otherwise(F.concat(F.lit("Frequency escalation to tier2 — suspicion score "), score)).alias("summary"), F.col("score").alias("__score")))
    corr = F.coalesce("message_id", "tool_call_id")
    pair = events.where(F.col("event").isin("syntactic_pass", "scan_block") & corr.isNotNull())
    # The latest pass of the same id before the block; it counts if it was clean.
    w = Window.partitionBy(corr, *_epoch(events)).orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.last(F.when(F.col("event") == "syntactic_pass", F.coalesce(F.size("rule_ids"), F.lit(0))), ignorenulls=True).over(w)
    gap = pair.withColumn("__p", passed).where((F.col("event") == "scan_block") & (F.col("__p") <= 0)).drop("__p")
    out = out.unionByName(gap.select("*", F.lit("scanBlockAfterSyntacticPass").alias("alert_rule"), F.lit("medium").alias("severity"), F.lit("Scanner blocked content that syntactic filter passed cleanly").alias("summary"), null.alias("__score")))
    schema = events.where((F.col("event") == "schema_fail") & F.col("trusted"))
    out = out.unionByName(schema.select("*", F.lit("trustedToolSchemaFail").alias("alert_rule"), F.lit("high").alias("severity"), F.concat(F.lit("Trusted tool "), F.col("server_name"), F.lit(":"), F.col("tool_name"), F.lit(" produced structurally invalid output")).alias("summary"), null.alias("__score")))
    off = [r for r in config.disabled if r != "frequencyEscalationTier3"]
    return out.where(~F.col("alert_rule").isin(*off)) if off else out


_HOUR = 3_600_000
_DAY = 24 * _HOUR


def occurrence_step(config: AlertConfig):
    """Rule 4's counter, which starts again a day after its window began, and the severity that follows from it."""

    def step(state, row):
        n, since = state or (0, row["ts_ms"])
        n += 1
        if row["ts_ms"] - since > _DAY:
            n, since = 1, row["ts_ms"]
        return (n, since), {"occurrence": n, "final_severity": "high" if n >= config.escalate_after else "medium"}

    return step


def dedup_step(config: AlertConfig):
    """Greedy per key: silent until the pause since the last accepted one is over."""
    hush = config.suppression_minutes * 60_000

    def step(last, row):
        if hush and last is not None and row["ts_ms"] - last < hush:
            return last, {"fresh": False}
        return row["ts_ms"], {"fresh": True}

    return step


def rate_step(config: AlertConfig):
    """Sliding limits a minute and an hour; only what is delivered counts."""

    def step(sent, row):
        sent, now = sent if sent is not None else deque(), row["ts_ms"]
        while sent and now - sent[0] >= _HOUR:
            sent.popleft()
        full = len(sent) >= config.per_hour or (len(sent) >= config.per_minute and now - sent[-config.per_minute] < 60_000)
        if not full:
            sent.append(now)
        return sent, {"delivered": not full}

    return step


def decide(rows: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """Candidates with disposition (delivered, suppressed, rate_limited), final_severity and occurrence.

    Dedup runs for all keys side by side. Rule 4's counter and, after dedup, the limits on what isn't critical are defined
    by one order; it is cut where a pause is so long that their state is empty, and the runs between are folded side by side.
    """
    order, epoch = ["ts_ms", "seq"], _epoch(rows)
    fourth = F.col("alert_rule") == "scanBlockAfterSyntacticPass"
    counted = keyed_fold(runs(rows.where(fourth), _DAY), [*epoch, "__run"], order, occurrence_step(config), [("occurrence", pa.int64(), "bigint"), ("final_severity", pa.string(), "string")], rows.columns)
    counted = counted.unionByName(rows.where(~fourth).withColumns({"occurrence": F.lit(None).cast("bigint"), "final_severity": F.col("severity")}))
    key = F.when(F.col("alert_rule") == "trustedToolSchemaFail", F.concat_ws(":", "server_name", "tool_name"))
    keyed = counted.withColumn("__tool", F.coalesce(key, F.lit("")))
    single = keyed_fold(keyed, ["alert_rule", "session_id", "__tool", *epoch], order, dedup_step(config), [("fresh", pa.bool_(), "boolean")], [*rows.columns, "occurrence", "final_severity"])
    limited = single.where(F.col("fresh") & (F.col("final_severity") != "critical"))
    sent = keyed_fold(runs(limited, _HOUR), [*epoch, "__run"], order, rate_step(config), [("delivered", pa.bool_(), "boolean")], [*rows.columns, "occurrence", "final_severity"])
    out = sent.withColumn("disposition", F.when(F.col("delivered"), "delivered").otherwise("rate_limited")).drop("delivered")
    rest = single.where(~F.col("fresh") | (F.col("final_severity") == "critical"))
    return out.unionByName(rest.withColumn("disposition", F.when(F.col("fresh"), "delivered").otherwise("suppressed")).drop("fresh"))


def _settings(config: AlertConfig) -> Column:
    """The settings of the rule that a row is of, as text by name."""
    of = {
        "syntacticFailBurst": {"count": config.burst_count, "windowMinutes": config.burst_minutes}, "writeFailSpike": {"count": config.write_count, "windowMinutes": config.write_minutes},
        "toolPolicyBlock": {"count": config.policy_count, "windowMinutes": config.policy_minutes}, "scanBlockAfterSyntacticPass": {"escalateAfter": config.escalate_after}, "trustedToolSchemaFail": {"enabled": True},
    }
    out = F.create_map().cast("map<string,string>")
    for rule, values in of.items():
        out = F.when(F.col("alert_rule") == rule, F.create_map(*(F.lit(str(x).lower() if isinstance(x, bool) else str(x) if i else x) for pair in values.items() for i, x in enumerate(pair)))).otherwise(out)
    return out


def build(decided: DataFrame, config: AlertConfig = AlertConfig(), events: DataFrame | None = None) -> DataFrame:
    """Delivered alerts with their id, a hash of rule, session and place; of events, the session's last ones up to the trigger are added as context."""
    ident = F.sha2(F.concat_ws("|", "alert_rule", F.coalesce("session_id", F.lit("")), F.col("ts_ms").cast("string"), F.col("seq").cast("string")), 256)
    more = F.when(F.col("occurrence").isNotNull(), F.concat(F.col("summary"), F.lit(" (occurrence "), F.col("occurrence").cast("string"), F.lit(")"))).otherwise(F.col("summary"))
    at = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    made = decided.where("disposition = 'delivered'").select(ident.alias("alert_id"), "alert_rule", F.col("final_severity").alias("severity"), "session_id", at.alias("timestamp"), "ts_ms", "seq", more.alias("summary"), F.col("__score").alias("score"), F.col("event").alias("trigger"), _settings(config).alias("rule_config"), *(c for c in ("agent_id",) if c in decided.columns))
    if events is None:
        return made
    told = recent_context(events, config.context).select(F.col("session_id").alias("__s"), F.col("ts_ms").alias("__t"), F.col("seq").alias("__q"), F.col("event").alias("__e"), "context")
    same = F.col("session_id").eqNullSafe(F.col("__s")) & (F.col("ts_ms") == F.col("__t")) & (F.col("seq") == F.col("__q")) & (F.col("trigger") == F.col("__e"))
    return made.join(told, same, "left").drop("__s", "__t", "__q", "__e")


def buffer_step(most_sessions: int):
    """Sessions held, by their first row; the one held longest goes when there are too many, and comes back as a new one."""

    def step(state, row):
        held, made = state or (OrderedDict(), 0)
        key = row["session_id"]
        if key not in held:
            made += 1
            held[key] = made
            if len(held) > most_sessions:
                held.popitem(last=False)
        return (held, made), {"buffer": held[key]}

    return step


def recent_context(events: DataFrame, most: int = 20, most_sessions: int | None = None) -> DataFrame:
    """Adds context: the last events of the session up to this one.

    With most_sessions, no more sessions than that are remembered, in one global order over (ts_ms, seq, session_id) alone.
    """
    held = []
    if most_sessions is not None:
        place = events.select("ts_ms", "seq", "session_id")
        told = keyed_fold(place, [], ["ts_ms", "seq"], buffer_step(most_sessions), [("buffer", pa.int64(), "bigint")], place.columns)
        told = told.groupBy("ts_ms", "seq", "session_id").agg(F.min("buffer").alias("__buffer")).withColumnsRenamed({"ts_ms": "__t", "seq": "__q", "session_id": "__s"})
        events = events.join(told, (F.col("ts_ms") == F.col("__t")) & (F.col("seq") == F.col("__q")) & F.col("session_id").eqNullSafe(F.col("__s"))).drop("__t", "__q", "__s")
        held = ["__buffer"]
    w = Window.partitionBy("session_id", *_epoch(events), *held).orderBy("ts_ms", "seq").rowsBetween(-(most - 1), 0)
    return events.withColumn("context", F.collect_list("event").over(w) if most else F.array().cast("array<string>")).drop(*held)


def stats(decided: DataFrame) -> DataFrame:
    one: Column = F.col("disposition")
    return decided.agg(F.count_if(one == "delivered").alias("alerts"), F.count_if(one == "suppressed").alias("suppressed"), F.count_if(one == "rate_limited").alias("rate_limited"))
