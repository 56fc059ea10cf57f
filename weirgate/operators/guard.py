"""Decisions on tool calls: session tier, exemptions, parameter findings, policy, escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import FrequencyConfig, GuardConfig

# Names of the same tool.
ALIASES = {"bash": "exec", "shell": "exec", "execute": "exec", "run_command": "exec", "file_read": "read", "file_write": "write", "file_edit": "write", "edit": "write", "apply_patch": "write", "web_fetch": "browser", "web_search": "browser", "navigate": "browser"}


def normal_tool(name: Column) -> Column:
    lower = F.lower(F.substring_index(name, "__", -1))
    out = lower
    for a, b in ALIASES.items():
        out = F.when(lower == a, b).otherwise(out)
    return out


def session_tier(score: Column, terminated: Column, config: FrequencyConfig) -> Column:
    """From the last score as it stands, without decay."""
    a, b, c = config.thresholds
    return F.when(terminated | (score >= c), "tier3").when(score >= b, "tier2").when(score >= a, "tier1").otherwise("none")


def decide(calls: DataFrame, config: GuardConfig = GuardConfig()) -> DataFrame:
    """Adds tool, params_hash, block, decision, reason, escalated. calls: tool_name, params, session_tier, policy_decision, policy_reason, and, where params were inspected, unsafe and n_findings.

    Where a call can't be judged (no tier, no policy), it is allowed.
    """
    tool, tier = normal_tool(F.col("tool_name")), F.coalesce("session_tier", F.lit("none"))
    policy = F.coalesce("policy_decision", F.lit("allow"))
    has = lambda n: n in calls.columns
    unsafe = F.coalesce("unsafe", F.lit(False)) & F.lit(config.scan_params) if has("unsafe") else F.lit(False)
    found = F.coalesce("n_findings", F.lit(0)) if has("n_findings") else F.lit(0)
    why = F.coalesce("policy_reason", F.lit("no reason")) if has("policy_reason") else F.lit("no reason")
    exempt = tool.isin(*(x.lower() for x in config.exempt)) if config.exempt else F.lit(False)
    named = lambda before, *after: F.concat(F.lit(before), tool, *after)
    terminated, refused = tier == "tier3", policy.isin("deny", "review")
    warned = (policy == "warn") & F.lit(config.escalate_warnings) & tier.isin("tier1", "tier2")
    restricted = (tier == "tier2") & ~tool.isin(*(x.lower() for x in config.restricted))
    block = F.when(terminated, True).when(exempt, False).when(unsafe, True).otherwise(refused | warned | restricted)
    reason = (
        F.when(terminated, "Session terminated — all tool calls blocked").when(exempt, F.lit(None).cast("string"))
        .when(unsafe, F.concat(F.lit("Tool parameter content flagged as unsafe ("), found.cast("string"), F.lit(" finding(s))")))
        .when(policy == "deny", named('Tool "', F.lit('" denied by policy: '), why)).when(policy == "review", named('Tool "', F.lit('" requires review (auto-blocked in agent pipeline)')))
        .when(warned, named('Tool "', F.lit('" warning escalated to block (session at '), tier, F.lit(")"))).when(restricted, named('Tool "', F.lit('" not in restricted allowlist (session at tier2)')))
    )
    decision = F.when(terminated, "deny").when(exempt, "allow").when(unsafe, "deny").otherwise(policy)
    escalated = F.when(terminated | exempt | unsafe, False).otherwise(~refused & (warned | restricted))
    return calls.withColumns({"tool": tool, "params_hash": F.sha2(F.coalesce("params", F.lit("")), 256), "block": F.coalesce(block, F.lit(False)), "decision": decision, "reason": reason, "escalated": F.coalesce(escalated, F.lit(False))})


def guard_events(decided: DataFrame) -> DataFrame:
    """tool_policy_block or tool_policy_allow for each call, and write_failed, with its cause, for each write that was blocked."""
    event = F.array_compact(F.array(F.when(F.col("block"), "tool_policy_block").otherwise("tool_policy_allow"), F.when(F.col("block") & (F.col("tool") == "write"), "write_failed")))
    rows = decided.withColumn("event", F.explode(event))
    failed = lambda x: F.when(F.col("event") == "write_failed", x)
    return rows.withColumns({"cause": failed(F.lit("policy_block")), "error_category": failed(F.lit("policy")), "error_summary": failed(F.coalesce("reason", F.lit("blocked by guard")))})


def state_at(calls: DataFrame, states: DataFrame) -> DataFrame:
    """Each call with its session's last state at its time: one window over both, no join of ranges."""
    from pyspark.sql import Window

    s = states.select("session_id", "ts_ms", F.lit(0).alias("__call"), F.struct("current_score", "terminated").alias("__s"))
    c = calls.select("session_id", "ts_ms", F.lit(1).alias("__call"), F.lit(None).cast(s.schema["__s"].dataType).alias("__s"), F.struct(*calls.columns).alias("__row"))
    w = Window.partitionBy("session_id").orderBy("ts_ms", "__call").rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(c, allowMissingColumns=True).withColumn("__last", F.last("__s", ignorenulls=True).over(w))
    return both.where("__call = 1").select("__row.*", F.col("__last.current_score").alias("last_score"), F.coalesce("__last.terminated", F.lit(False)).alias("last_terminated"))
