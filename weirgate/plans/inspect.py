"""Inspection of messages: pure stages for all rows, then one ordered fold per session over narrow rows that decides what counts.

Texts are searched and redacted once, before the fold. What the stages found travels through its shuffle, with a text only
where there are findings. Whoever wants the contents back takes `results`, one more join by session and place. Null is a session
like any other.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions.text import millis
from ..operators import frequency as Q
from ..operators.fold import keyed_fold
from ..operators.guard import decide, normal_tool, session_tier
from ..operators.prefilter import prefilter
from ..operators.redact import redact
from ..operators.scanner import PACK, detect
from ..operators.schema import validate
from ..sources.messages import union_events
from .config import GuardConfig, PipelineConfig

_FREQ = [(f"{k}{n}", t, s) for n in (1, 2) for k, t, s in (("previous", pa.float64(), "double"), ("score", pa.float64(), "double"), ("tier", pa.string(), "string"))]
_OUT = [("path", pa.string(), "string"), ("scanned", pa.bool_(), "boolean"), ("tier", pa.string(), "string"), ("terminated", pa.bool_(), "boolean"), ("prior", pa.float64(), "double"), *_FREQ]


def inspect_step(config: PipelineConfig):
    """A row has ts_ms, trusted, rejected, pre_pass, n_pre, w_pre, hard, n_scan, w_scan. path: trusted, terminated, stopped, gated or full; prior: the score as it stood before."""
    c = config.frequency
    none = {n: None for n, _, _ in _FREQ}

    def freq(n: int, r: dict) -> dict:
        return {f"previous{n}": r["previous_score"], f"score{n}": r["current_score"], f"tier{n}": r["tier"]}

    def step(state, row):
        out = {"path": "full", "scanned": False, "tier": "none", "terminated": False, "prior": None, **none}
        if row["trusted"]:
            return state, out | {"path": "trusted"}
        if state is not None and row["ts_ms"] - state["last"] > c.ttl_ms:
            state = None
        known = not row["rejected"]
        prior = state if known else None
        if prior is not None and prior["terminated"]:
            return state, out | {"path": "terminated", "tier": "tier3", "terminated": True, "prior": prior["score"], "score1": prior["score"], "previous1": prior["score"]}
        before = prior["score"] if prior is not None else None
        out["prior"] = before
        if known and row["n_pre"]:
            state, r = Q.update(state, row["ts_ms"], row["w_pre"], row["n_pre"], c)
            out |= freq(1, r) | {"tier": r["tier"], "terminated": r["terminated"]}
            if r["terminated"]:
                return state, out | {"path": "stopped"}
        skip = config.two_pass and not row["pre_pass"] and row["hard"] and not (before is not None and before >= c.thresholds[0])
        if skip:
            return state, out | {"path": "gated"}
        out["scanned"] = config.scanner.enabled
        if known and out["scanned"] and row["n_scan"]:
            state, r = Q.update(state, row["ts_ms"], row["w_scan"], row["n_scan"], c)
            out |= freq(2, r) | {"tier": r["tier"], "terminated": r["terminated"]}
        return state, out

    return step


@dataclass(frozen=True)
class Inspected:
    #: Messages with all their columns and what was decided.
    results: DataFrame
    #: The same without contents and further columns of the messages, and without the shuffle that brings them back.
    decisions: DataFrame
    config: PipelineConfig

    def updates(self) -> DataFrame:
        """Score updates in order: session_id, ts_ms, seq, step, previous, score, tier."""
        steps = F.array(*(F.struct(F.lit(n).alias("step"), F.col(f"previous{n}").alias("previous"), F.col(f"score{n}").alias("score"), F.col(f"tier{n}").alias("tier")) for n in (1, 2)))
        place = ["session_id", "ts_ms", "seq", *side_of(self.decisions)]
        return self.decisions.select(*place, F.explode(steps).alias("u")).where("u.tier is not null").select(*place, "u.*")

    def transitions(self) -> DataFrame:
        """Updates whose tier is above every earlier one of their session."""
        return transitions(self.updates())


def side_of(rows: DataFrame) -> list[str]:
    return [n for n in ("side",) if n in rows.columns]


def transitions(updates: DataFrame) -> DataFrame:
    """Each side remembers the tiers that it has told of by itself."""
    before = Window.partitionBy("session_id", *side_of(updates)).orderBy("ts_ms", "seq", "step").rowsBetween(Window.unboundedPreceding, -1)
    return updates.withColumn("rank", Q.rank(F.col("tier"))).withColumn("__most", F.coalesce(F.max("rank").over(before), F.lit(0))).where("rank > __most").drop("__most")


def _with_text(messages: DataFrame) -> DataFrame:
    return messages.withColumn("content", F.coalesce(J.stringify(F.col("content"), messages.schema["content"].dataType), F.lit("")))


def stages(messages: DataFrame, config: PipelineConfig, pack=PACK) -> DataFrame:
    """The columns that don't depend on the session: pre, schema, findings, trusted."""
    df = prefilter(_with_text(messages), config.prefilter)
    df = validate(df, config.schema)
    df = detect(df, config.scanner, pack)
    trusted = (F.col("source") == "mcp") & F.col("server_name").isNotNull() & F.col("server_name").isin(*config.trusted_servers) if config.trusted_servers else F.lit(False)
    return df.withColumn("trusted", F.coalesce(trusted, F.lit(False)))


_FOUND = ["ts_ms", "trusted", "rejected", "pre", "schema", "findings", "sanitized"]
_SAID = ["message_id", "tool_call_id", "source", "server_name", "tool_name", "agent_id"]


def _narrow(messages: DataFrame, config: PipelineConfig, pack, rejected) -> DataFrame:
    """What the stages find, redacted texts of rows with findings among it, and the weights that the fold adds up."""
    df = stages(messages, config, pack).withColumn("ts_ms", millis("ts")).withColumn("rejected", F.lit(False) if rejected is None else F.coalesce(rejected, F.lit(False)))
    df = redact(df, replace(config.sanitize, enabled=True)).withColumn("sanitized", F.when((F.size("findings") > 0) & F.lit(config.sanitize.enabled), F.col("sanitized")))
    ids = F.transform("findings", lambda f: f.rule_id)
    said = [(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in _SAID]
    return df.select(
        "session_id", "seq", *said, *_FOUND, F.col("pre.pass").alias("pre_pass"), F.size("pre.rule_ids").alias("n_pre"), Q.total_weight(F.col("pre.rule_ids"), config.frequency).alias("w_pre"),
        F.arrays_overlap("pre.rule_ids", F.array(*map(F.lit, config.hard_block))).alias("hard"), F.size("findings").alias("n_scan"), Q.total_weight(ids, config.frequency).alias("w_scan"),
    )


def inspect_sides(sides: dict[str, tuple[DataFrame, PipelineConfig]], pack=PACK, rejected=None) -> Inspected:
    """Several kinds of messages, as inbound and outbound ones, each by its own settings but with one score for a session.

    Results have a further column, side. What the fold needs must be the same on all sides: scores, the two passes, and how
    texts are redacted. (side, session_id, seq) is unique.
    """
    configs = [c for _, c in sides.values()]
    first = configs[0]
    alike = lambda c: (c.frequency, c.two_pass, c.scanner.enabled, replace(c.sanitize, enabled=True))
    if any(alike(c) != alike(first) for c in configs):
        raise ValueError("the sides share one tracker: their scores, passes and redaction must be alike")
    narrow = union_events(*(_narrow(m, c, pack, rejected).withColumn("side", F.lit(name)) for name, (m, c) in sides.items()))
    place = ["session_id", "seq", "side"]
    decided = keyed_fold(narrow, ["session_id"], ["ts_ms", "seq", "side"], inspect_step(first), _OUT, [*place, *_SAID, *_FOUND])
    early = F.col("path").isin("trusted", "terminated")
    scan_safe = ~F.exists("findings", lambda f: f.blocked)
    safe = F.when(F.col("path") == "trusted", True).when(F.col("path").isin("terminated", "stopped"), False).otherwise(F.col("pre.pass") & (~F.col("scanned") | scan_safe))
    decisions = decided.withColumn("safe", safe).withColumns({
        "pre": F.when(~early, F.col("pre")),
        "schema": F.when(F.col("path").isin("trusted", "full"), F.col("schema")),
        "findings": F.when(F.col("scanned"), F.col("findings")),
        "sanitized": F.when(F.col("scanned"), F.col("sanitized")),
    })
    # Only results bring the contents back, in one join by session and place.
    made = [*_FOUND, "safe", *(n for n, _, _ in _OUT)]
    own = union_events(*(_with_text(m).drop(*made).withColumn("side", F.lit(name)) for name, (m, _) in sides.items()))
    found = decisions.select(*(F.col(c).alias(f"__{c}") for c in place), *made)
    same = F.col("session_id").eqNullSafe(F.col("__session_id")) & (F.col("seq") == F.col("__seq")) & (F.col("side") == F.col("__side"))
    return Inspected(own.join(found, same).drop(*(f"__{c}" for c in place)), decisions, first)


def inspect_calls(messages: DataFrame, calls: DataFrame, config: PipelineConfig = PipelineConfig(), guard: GuardConfig = GuardConfig(), pack=PACK) -> DataFrame:
    """Decisions on tool calls whose parameters count in the same score as the messages.

    calls: session_id, ts, seq, tool_name, params, policy_decision, policy_reason; (session_id, seq) is unique among them. The
    tier is that before the call, from the score as it stands. Calls of exempt tools, or without parameters, add nothing.
    """
    tool = normal_tool(F.col("tool_name"))
    free = tool.isin(*(x.lower() for x in guard.exempt)) if guard.exempt else F.lit(False)
    content = F.when(~free & F.lit(guard.scan_params), F.col("params"))
    none = F.lit(None).cast("string")
    asked = calls.select("session_id", "ts", "seq", none.alias("message_id"), none.alias("tool_call_id"), F.lit("tool_params").alias("source"), none.alias("server_name"), "tool_name", F.coalesce(content, F.lit("")).alias("content"))
    made = inspect_sides({"message": (messages, config), "call": (asked, config)}, pack).decisions.where("side = 'call'")
    tier = session_tier(F.coalesce("prior", F.lit(0.0)), F.col("path") == "terminated", config.frequency)
    found = made.select(F.col("session_id").alias("__session_id"), F.col("seq").alias("__seq"), (~F.col("safe")).alias("unsafe"), F.coalesce(F.size("findings"), F.lit(0)).alias("n_findings"), tier.alias("session_tier"))
    same = F.col("session_id").eqNullSafe(F.col("__session_id")) & (F.col("seq") == F.col("__seq"))
    return decide(calls.drop("unsafe", "n_findings", "session_tier").join(found, same).drop("__session_id", "__seq"), guard)


def inspect(messages: DataFrame, config: PipelineConfig = PipelineConfig(), pack=PACK, rejected=None) -> Inspected:
    """messages: session_id, ts, seq, content, source, server_name, tool_name, message_id, tool_call_id. (session_id, seq) is unique.

    Results keep every message: verdict, tier, and the stages that its path exposes, null elsewhere.
    """
    made = inspect_sides({"": (messages, config)}, pack, rejected)
    return Inspected(made.results.drop("side"), made.decisions.drop("side"), config)
