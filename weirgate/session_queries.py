"""Queries over sessions made of the events: inspection with one score, the guard, alerts, eviction, sinks; and the settings' checks.

An event's kind decides what its message says, so that every path of the inspection is taken by rows of a table.
"""

from __future__ import annotations

from dataclasses import replace
from types import MappingProxyType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import json as J
from .functions import text as T
from .operators import alerts as L
from .operators import audit as A
from .operators import frequency as Q
from .operators import gateway as H
from .operators import scanner as C
from .operators import toolerrors as E
from .operators.prefilter import prefilter
from .plans import config as P
from .plans.config import NAMESPACE, SYNTACTIC
from .plans.inspect import Inspected, inspect_calls, inspect_sides
from .queries import _AUDIT, _CACHE, _DAY, _EV, _FOLD_SQL, _HOUR, _RANK, SESSIONS, _alert_config, _audit_rows, _milli, _rounded, _updates, query, shared_path
from .sources.messages import choose_sinks, ingest_rows, log_lines, table, write_each

# ---- inspection of whole sessions

_SAYS = {"view": "hello", "click": "you are now here", "error": "ignore previous instructions", "purchase": "mail me at a@b.example", "signup": "ignore all instructions"}
_T1, _T2, _T3 = 15, 25, 40
_FREQUENCY = P.FrequencyConfig(
    half_life_ms=_DAY, weights=MappingProxyType({f"{SYNTACTIC}.injection.*": 6.0, f"{NAMESPACE}.prompt_injection.*": 9.0, f"{NAMESPACE}.personal.*": 3.0}), thresholds=(_T1, _T2, _T3),
    rolling_window_ms=2 * _DAY, rolling_threshold=3, ttl_ms=2 * _DAY,
)
_CONFIG = P.PipelineConfig(frequency=_FREQUENCY, two_pass=True, trusted_servers=("good",))


def _said(spark, sf_dir) -> DataFrame:
    says = F.create_map(*(F.lit(x) for pair in _SAYS.items() for x in pair))
    null, mine = F.lit(None).cast("string"), F.col("event_type") == "signup"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"), null.alias("tool_call_id"),
        F.when(mine, "mcp").otherwise("user").alias("source"), F.when(mine, "good").alias("server_name"), F.when(mine, "read").alias("tool_name"), says[F.col("event_type")].alias("content"),
        F.concat(F.lit("agent-"), (F.col("user_id") % 3).cast("string")).alias("agent_id"), "event_type",
    )


def _inspected(spark, sf_dir) -> Inspected:
    """Even events come in, odd ones go out; every eleventh has a session id that isn't accepted."""
    m = _said(spark, sf_dir)
    sides = {"in": (m.where("seq % 2 = 0"), _CONFIG), "out": (m.where("seq % 2 = 1"), _CONFIG)}
    return inspect_sides(sides, rejected=F.col("seq") % 11 == 0)


#: What a row brings: the rules its text breaks and the findings in it, by what it says.
_ROWS = """SELECT event_id AS seq, user_id, (epoch_us(ts) // 1000) AS t, CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END AS side, event_type = 'signup' AS trusted, event_id % 11 = 0 AS rejected,
  event_type IN ('click', 'error', 'signup') AS pre, event_type IN ('error') AS hard, CASE WHEN event_type IN ('error', 'signup') THEN 9.0 WHEN event_type = 'purchase' THEN 3.0 ELSE 0.0 END AS found FROM events"""
_CALL_ROWS = """SELECT event_id AS seq, user_id, (epoch_us(ts) // 1000) AS t, CASE WHEN event_type IN ('purchase', 'signup') THEN 'call' ELSE 'message' END AS side, false AS trusted, false AS rejected,
  event_type IN ('click', 'error') AS pre, event_type = 'error' AS hard, CASE WHEN event_type = 'error' THEN 9.0 WHEN event_type IN ('purchase', 'signup') AND event_id % 3 > 0 AND event_id % 4 < 3 THEN 3.0 ELSE 0.0 END AS found FROM events"""


def _inspect_sql(rows: str) -> str:
    """The session fold in SQL, one row of every session a round: i is what each message gave."""
    decay = f"exp(-(t - last) * ln(2.0) / {_DAY})"
    return f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, seq) AS rn FROM ({rows})),
i AS (
  SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::BIGINT AS t, NULL::VARCHAR AS side, NULL::DOUBLE AS score, NULL::BIGINT AS last, false AS dead, []::BIGINT[] AS rolling,
    NULL::VARCHAR AS path, false AS scanned, NULL::VARCHAR AS tier1, NULL::VARCHAR AS tier2, NULL::DOUBLE AS score1, NULL::DOUBLE AS score2, NULL::DOUBLE AS prior, false AS pre, 0.0::DOUBLE AS found FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL
  SELECT user_id, rn, seq, t, side, CASE WHEN u2 THEN s2 ELSE a END, CASE WHEN u1 OR u2 THEN t ELSE last END, CASE WHEN u2 THEN s2 >= {_T3} ELSE adead END, CASE WHEN u2 THEN r2 ELSE ar END,
    path, path = 'full', t1, CASE WHEN u2 THEN CASE WHEN s2 >= {_T3} THEN 'tier3' WHEN s2 >= {_T2} THEN 'tier2' WHEN s2 >= {_T1} OR len(r2) >= 3 THEN 'tier1' ELSE 'none' END END,
    CASE WHEN u1 THEN a WHEN path = 'terminated' THEN score END, CASE WHEN u2 THEN s2 END, CASE WHEN known AND NOT trusted THEN score END, pre, found::DOUBLE
  FROM (SELECT *, path = 'full' AND known AND found > 0 AS u2, coalesce(CASE WHEN u1 THEN a ELSE score * {decay} END, 0) + found AS s2, list_append([x for x in ar if x >= t - {2 * _DAY}], t) AS r2
    FROM (SELECT *, CASE WHEN trusted THEN 'trusted' WHEN known AND dead THEN 'terminated' WHEN u1 AND adead THEN 'stopped' WHEN pre AND hard AND NOT coalesce(known AND score >= {_T1}, false) THEN 'gated' ELSE 'full' END AS path,
        CASE WHEN u1 THEN CASE WHEN a >= {_T3} THEN 'tier3' WHEN a >= {_T2} THEN 'tier2' WHEN a >= {_T1} OR len(ar) >= 3 THEN 'tier1' ELSE 'none' END END AS t1
      FROM (SELECT *, CASE WHEN u1 THEN s1 ELSE score END AS a, CASE WHEN u1 THEN s1 >= {_T3} ELSE dead END AS adead, CASE WHEN u1 THEN list_append([x for x in rolling if x >= t - {2 * _DAY}], t) ELSE rolling END AS ar
        FROM (SELECT *, NOT trusted AND known AND pre AND NOT dead AS u1, coalesce(score * {decay}, 0) + 6 AS s1
          FROM (SELECT o.*, NOT o.rejected AS known, lives, CASE WHEN lives THEN score END AS score, CASE WHEN lives THEN last END AS last, lives AND dead AS dead, CASE WHEN lives THEN rolling ELSE [] END AS rolling
            FROM (SELECT i.user_id, i.rn, i.score, i.last, i.dead, i.rolling, o AS row, i.last IS NOT NULL AND o.t - i.last <= {2 * _DAY} AS lives FROM i JOIN o ON o.user_id = i.user_id AND o.rn = i.rn + 1) p JOIN o ON o.user_id = p.user_id AND o.rn = p.rn + 1)))))
),
m AS (SELECT user_id::VARCHAR AS session_id, seq, t, side, path, scanned, tier1, tier2, score1, score2, prior, pre, found, CASE WHEN path = 'terminated' THEN 'tier3' ELSE coalesce(tier2, tier1, 'none') END AS tier,
  path = 'terminated' OR coalesce(tier2, tier1, 'none') = 'tier3' AS terminated, CASE WHEN path = 'trusted' THEN true WHEN path IN ('terminated', 'stopped') THEN false ELSE NOT pre AND (NOT scanned OR found = 0) END AS safe FROM i WHERE rn > 0)
"""


_M = _inspect_sql(_ROWS)


@query(_M + "SELECT session_id, seq, side, path, scanned, safe, tier, terminated, coalesce(round(score1 * 1000)::BIGINT, -1) AS first_milli, coalesce(round(score2 * 1000)::BIGINT, -1) AS second_milli, scanned AND found > 0 AS redacted FROM m")
def session_inspection(spark, sf_dir):
    r = _inspected(spark, sf_dir).decisions
    return r.select("session_id", "seq", "side", "path", "scanned", "safe", "tier", "terminated", *(F.coalesce(_milli(c, n), F.lit(-1).cast("bigint")).alias(n) for c, n in (("score1", "first_milli"), ("score2", "second_milli"))), F.coalesce(F.col("sanitized.count") > 0, F.lit(False)).alias("redacted"))


_U = "u AS (SELECT session_id, seq, t, side, 1 AS step, tier1 AS tier, path FROM m WHERE tier1 IS NOT NULL UNION ALL SELECT session_id, seq, t, side, 2, tier2, path FROM m WHERE tier2 IS NOT NULL)"
_RISING = f"rising AS (SELECT * FROM (SELECT *, {_RANK} AS r, coalesce(max({_RANK}) OVER (PARTITION BY session_id, side ORDER BY t, seq, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS most FROM u) WHERE r > most)"


@query(_M + f", {_U}, {_RISING} SELECT session_id, seq, side, step, tier FROM rising")
def session_transitions(spark, sf_dir):
    return _inspected(spark, sf_dir).transitions().select("session_id", "seq", "side", "step", "tier")


_ORDER = """, said AS (SELECT m.*, a.tier AS rise1, b.tier AS rise2 FROM m LEFT JOIN rising a ON a.seq = m.seq AND a.step = 1 LEFT JOIN rising b ON b.seq = m.seq AND b.step = 2)
SELECT seq, array_to_string(list_filter([
  CASE WHEN path = 'terminated' THEN 'frequency_escalation_tier3' END,
  CASE WHEN path NOT IN ('terminated', 'trusted') THEN CASE WHEN pre THEN 'syntactic_fail' ELSE 'syntactic_pass' END END,
  CASE WHEN path NOT IN ('terminated', 'trusted') AND pre THEN 'rule_triggered' END,
  'frequency_escalation_' || rise1,
  CASE WHEN path = 'trusted' THEN 'schema_pass' END,
  CASE WHEN path = 'trusted' OR (scanned AND found = 0) THEN 'scan_pass' WHEN scanned THEN 'scan_block' END,
  CASE WHEN scanned AND found > 0 THEN 'rule_triggered' END,
  'frequency_escalation_' || rise2,
  CASE WHEN scanned AND found > 0 THEN 'content_sanitized' END, CASE WHEN scanned AND found > 0 THEN 'output_diff' END,
  CASE WHEN path IN ('full', 'gated') THEN 'raw_input_captured' END, CASE WHEN scanned AND found > 0 THEN 'raw_output_captured' END], lambda e: e IS NOT NULL), ',') AS events FROM said WHERE events <> ''"""


@query(_M + f", {_U}, {_RISING}{_ORDER}")
def audit_order(spark, sf_dir):
    """All events of a message in the order in which they go out."""
    e = A.events(_inspected(spark, sf_dir).results, P.AuditConfig(verbosity="maximum"))
    listed = F.array_sort(F.collect_list(F.struct("place", "event")))
    return e.groupBy("seq").agg(F.array_join(F.transform(listed, lambda x: x.event), ",").alias("events"))


_COUNTS = f""", {_U}, {_RISING}, e AS (
  SELECT 'frequency_escalation_' || tier AS event FROM rising UNION ALL SELECT 'frequency_escalation_tier3' FROM m WHERE path = 'terminated'
  UNION ALL SELECT 'syntactic_fail' FROM m WHERE path NOT IN ('terminated', 'trusted') AND pre UNION ALL SELECT 'syntactic_pass' FROM m WHERE path NOT IN ('terminated', 'trusted') AND NOT pre
  UNION ALL SELECT 'scan_block' FROM m WHERE scanned AND found > 0)
SELECT event, count(*) AS n FROM e GROUP BY event UNION ALL SELECT 'profile_loaded', 1 UNION ALL SELECT 'audit_config_loaded', 1"""


@query(_M + _COUNTS)
def audit_run(spark, sf_dir):
    """A run at the least verbosity while alerting is on: its start, its scores' events, and clean passes, which always go out."""
    config = P.AuditConfig(verbosity="minimal", alerting=True)
    return A.run_events(_inspected(spark, sf_dir).decisions, config, "research").groupBy("event").agg(F.count("*").alias("n"))


# ---- the guard



@query(_inspect_sql(_CALL_ROWS) + f""", c AS (SELECT seq, ['read', 'exec', 'browser', 'ping'][seq % 4 + 1] AS tool, seq % 4 = 3 AS free, CASE WHEN path = 'terminated' THEN 'tier3' WHEN prior >= {_T2} THEN 'tier2' WHEN prior >= {_T1} THEN 'tier1' ELSE 'none' END AS tier, NOT safe AS unsafe,
    ['allow', 'warn', 'deny'][seq % 5 % 3 + 1] AS policy FROM m WHERE side = 'call')
SELECT seq, tool, tier AS session_tier, CASE WHEN tier = 'tier3' THEN true WHEN free THEN false WHEN unsafe THEN true ELSE policy = 'deny' OR (policy = 'warn' AND tier IN ('tier1', 'tier2')) OR (tier = 'tier2' AND tool <> 'read') END AS block,
  CASE WHEN tier = 'tier3' THEN 'deny' WHEN free THEN 'allow' WHEN unsafe THEN 'deny' ELSE policy END AS decision, sha256(CASE WHEN seq % 3 > 0 THEN 'mail me at a@b.example' ELSE '' END) AS params_hash FROM c""")
def guard_parameters(spark, sf_dir):
    """Purchases and sign-ups as tool calls; what their parameters hold counts in the score of the messages."""
    m = _said(spark, sf_dir)
    calls = m.where("event_type in ('purchase', 'signup')").select(
        "session_id", "ts", "seq", F.element_at(F.expr("array('read', 'v__Bash', 'web_fetch', 'ping')"), (F.col("seq") % 4 + 1).cast("int")).alias("tool_name"), F.when(F.col("seq") % 3 > 0, "mail me at a@b.example").alias("params"),
        F.element_at(F.expr("array('allow', 'warn', 'deny')"), (F.col("seq") % 5 % 3 + 1).cast("int")).alias("policy_decision"), F.lit("said so").alias("policy_reason"),
    )
    made = inspect_calls(m.where("event_type not in ('purchase', 'signup')"), calls, _CONFIG, P.GuardConfig(exempt=("ping",)))
    return made.select("seq", "tool", "session_tier", "block", "decision", "params_hash")


# ---- eviction and resets

_MOST = 50


@query(f"""
WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY t, seq) AS rn FROM ({_EV})),
f AS (
  SELECT 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::BIGINT AS user_id, []::STRUCT(k BIGINT, n BIGINT, score DOUBLE, last BIGINT, dead BOOLEAN, rolling BIGINT[])[] AS held, []::BIGINT[] AS born, 0.0::DOUBLE AS previous, 0.0::DOUBLE AS score, 'none' AS tier, false AS terminated
  UNION ALL
  SELECT rn, seq, user_id, CASE WHEN refused THEN live WHEN len(rest) >= {_MOST} THEN list_append(list_filter(rest, lambda x: x.n <> list_sort(list_transform(rest, lambda y: {{'a': NOT y.dead, 'b': CASE WHEN y.dead THEN 0 ELSE y.last END, 'c': y.n}}))[1].c), mine) ELSE list_append(rest, mine) END,
    CASE WHEN me IS NULL AND NOT refused THEN list_append(near, t) ELSE born END, CASE WHEN refused THEN 0.0 ELSE d END, CASE WHEN refused THEN 0.0 ELSE mine.score END,
    CASE WHEN refused THEN 'none' WHEN mine.dead THEN 'tier3' WHEN mine.score >= 25 THEN 'tier2' WHEN mine.score >= 15 OR len(mine.rolling) >= 6 THEN 'tier1' ELSE 'none' END, NOT refused AND mine.dead
  FROM (SELECT *, list_filter(live, lambda x: x.k <> user_id) AS rest, CASE WHEN me.dead THEN me ELSE {{'k': user_id, 'n': coalesce(me.n, rn), 'score': d + w, 'last': t, 'dead': d + w >= 34, 'rolling': CASE WHEN hits > 0 THEN list_append(r, t) ELSE r END}} END AS mine
    FROM (SELECT *, me IS NULL AND len(live) >= {_MOST} AND len(near) >= 1 AS refused, CASE WHEN me.dead THEN me.score ELSE coalesce(me.score * exp(-(t - me.last) * ln(2.0) / {2 * _DAY}), 0.0) END AS d, coalesce(list_filter(me.rolling, lambda x: x >= t - {3 * _DAY}), []) AS r
      FROM (SELECT *, list_filter(live, lambda x: x.k = user_id)[1] AS me, list_filter(born, lambda x: x > t - 60000) AS near
        FROM (SELECT o.*, list_filter(f.held, lambda x: x.last >= o.t - {2 * _DAY}) AS live, f.born FROM f JOIN o ON o.rn = f.rn + 1))))
)
SELECT user_id::VARCHAR AS session_id, seq, round(previous * 1000)::BIGINT AS previous_milli, round(score * 1000)::BIGINT AS score_milli, tier, terminated FROM f WHERE rn > 0""")
def freq_capacity(spark, sf_dir):
    """The strict form: all sessions in one order, evicted over capacity, and at most one new one a minute while full."""
    return _rounded(Q.frequency(_updates(spark, sf_dir), replace(SESSIONS, strict_capacity=True, max_sessions=_MOST, max_new_sessions_per_minute=1)))


_RESET = f"(SELECT seq, user_id || '-' || sum((seq % 10 = 0)::INT) OVER (PARTITION BY user_id ORDER BY t, seq) AS user_id, t, w, hits FROM ({_EV}) QUALIFY seq % 10 > 0)"


@query(_FOLD_SQL.replace(f"({_EV})", _RESET) + "SELECT seq, score_milli, tier FROM g")
def freq_reset(spark, sf_dir):
    """Every tenth event drops its session, which starts anew."""
    u = _updates(spark, sf_dir).withColumn("control", F.when(F.col("seq") % 10 == 0, "reset"))
    return Q.frequency(u, SESSIONS).select("seq", _milli("current_score", "score_milli"), "tier")


@query("SELECT 'none' AS tier, 0::BIGINT AS score_milli, count(*) AS n FROM events")
def freq_disabled(spark, sf_dir):
    return Q.frequency(_updates(spark, sf_dir), replace(SESSIONS, enabled=False)).groupBy("tier", _milli("current_score", "score_milli")).agg(F.count("*").alias("n"))


# ---- alerts

_KINDS = {"view": "frequency_escalation_tier2", "click": "frequency_escalation_tier3", "error": "tool_policy_block", "purchase": "schema_fail", "signup": "write_failed"}
_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"
_KIND_ROWS = f"SELECT event_id AS seq, (epoch_us(ts) // 1000) AS t, user_id::VARCHAR AS session_id, {_KIND} AS event, value AS score, user_id % 2 = 0 AS trusted, 'server' AS server_name, 'tool' || event_id % 3 AS tool_name FROM events"


def _kind_rows(spark, sf_dir) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair))
    null = F.lit(None).cast("string")
    return table(spark, sf_dir, "events").select(
        kinds[F.col("event_type")].alias("event"), T.millis("ts").alias("ts_ms"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("session_id"), null.alias("message_id"), null.alias("tool_call_id"),
        F.array().cast("array<string>").alias("rule_ids"), F.col("value").alias("score"), (F.col("user_id") % 2 == 0).alias("trusted"), F.lit("server").alias("server_name"), F.concat(F.lit("tool"), (F.col("seq") % 3).cast("string")).alias("tool_name"),
        F.concat(F.lit("agent-"), (F.col("user_id") % 3).cast("string")).alias("agent_id"),
    )


_ONE = "printf('%.1f', round(score::DECIMAL(18, 2), 1)::DOUBLE)"
_BLOCKED = f"SELECT a.seq, a.session_id, least(count(*), 1000) AS n FROM ({_KIND_ROWS}) a JOIN ({_KIND_ROWS}) b ON b.event = a.event AND b.t > a.t - {2 * _HOUR} AND (b.t < a.t OR (b.t = a.t AND b.seq <= a.seq)) WHERE a.event = 'tool_policy_block' GROUP BY a.seq, a.session_id HAVING count(*) >= 2"


@query(f"""WITH k AS ({_KIND_ROWS})
SELECT seq, session_id, 'frequencyEscalationTier2' AS alert_rule, 'high' AS severity, 'Frequency escalation to tier2 — suspicion score ' || {_ONE} AS summary FROM k WHERE event = 'frequency_escalation_tier2'
UNION ALL SELECT seq, session_id, 'frequencyEscalationTier3', 'critical', 'Session terminated — suspicion score ' || {_ONE} || ' exceeded tier3 threshold' FROM k WHERE event = 'frequency_escalation_tier3'
UNION ALL SELECT seq, session_id, 'trustedToolSchemaFail', 'high', 'Trusted tool server:' || tool_name || ' produced structurally invalid output' FROM k WHERE event = 'schema_fail' AND trusted
UNION ALL SELECT seq, session_id, 'toolPolicyBlock', 'high', 'Tool call blocked by policy guard (' || n || ' in 120 minutes)' FROM ({_BLOCKED})""")
def alert_kinds(spark, sf_dir):
    """Rules on tiers, trusted tools and policy blocks, with their texts; the rule on write failures is off."""
    rows = L.candidates(_kind_rows(spark, sf_dir), _alert_config(policy_count=2, policy_minutes=120, disabled=("writeFailSpike",)))
    return rows.select("seq", "session_id", "alert_rule", "severity", "summary")


@query(f"""WITH RECURSIVE k AS (SELECT * FROM ({_KIND_ROWS}) WHERE event = 'schema_fail' AND trusted), c AS (SELECT *, row_number() OVER (PARTITION BY session_id, tool_name ORDER BY t, seq) AS rn FROM k),
f AS (SELECT session_id, tool_name, seq, rn, t AS last, true AS ok FROM c WHERE rn = 1 UNION ALL SELECT c.session_id, c.tool_name, c.seq, c.rn, CASE WHEN c.t - f.last >= {2 * _DAY} THEN c.t ELSE f.last END, c.t - f.last >= {2 * _DAY} FROM f JOIN c ON c.session_id = f.session_id AND c.tool_name = f.tool_name AND c.rn = f.rn + 1)
SELECT f.seq, 'agent-' || f.session_id::BIGINT % 3 AS agent_id, 'schema_fail' AS trigger, strftime(make_timestamp(k.t * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp FROM f JOIN k ON k.seq = f.seq WHERE f.ok""")
def alert_built(spark, sf_dir):
    """Whole alerts on trusted tools, one for a session and tool in two days."""
    config = _alert_config(suppression_minutes=48 * 60)
    rows = L.candidates(_kind_rows(spark, sf_dir).where("event = 'schema_fail'"), config)
    return L.build(L.decide(rows, config), config).select("seq", "agent_id", "trigger", "timestamp")


@query(f"SELECT disposition, count(*) AS n FROM (SELECT CASE WHEN event = 'frequency_escalation_tier3' THEN 'delivered' END AS disposition FROM ({_KIND_ROWS}) WHERE event = 'frequency_escalation_tier3') GROUP BY 1")
def alert_critical(spark, sf_dir):
    """What ends a session is always delivered: it can't be turned off, and no limit holds for it."""
    config = _alert_config(per_minute=1, per_hour=1, disabled=("frequencyEscalationTier3",))
    return L.decide(L.candidates(_kind_rows(spark, sf_dir).where("event = 'frequency_escalation_tier3'"), config), config).groupBy("disposition").agg(F.count("*").alias("n"))


_CLEAR = 1_705_000_000_000


@query(f"SELECT b.seq FROM ({_AUDIT}) b WHERE b.event = 'scan_block' AND EXISTS (SELECT 1 FROM ({_AUDIT}) a WHERE a.event = 'syntactic_pass' AND a.session_id = b.session_id AND (a.t >= {_CLEAR}) = (b.t >= {_CLEAR}) AND (a.t < b.t OR (a.t = b.t AND a.seq < b.seq)))")
def alert_cleared(spark, sf_dir):
    """After a clear no earlier pass is remembered."""
    rows = L.candidates(L.cleared(_audit_rows(spark, sf_dir), [_CLEAR]), _alert_config())
    return rows.where("alert_rule = 'scanBlockAfterSyntacticPass'").select("seq")


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'event' WHEN event_id % 5 = 0 THEN 'ts_ms' WHEN event_id % 3 = 0 THEN 'score' ELSE 'none' END AS reason FROM events WHERE event_type <> 'view') GROUP BY reason")
def alert_quarantine(spark, sf_dir):
    spoilt = _audit_rows(spark, sf_dir).withColumns({
        "event": F.when(F.col("seq") % 7 > 0, F.col("event")), "ts_ms": F.when(F.col("seq") % 5 > 0, F.col("ts_ms")), "score": F.when(F.col("seq") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("score")),
    })
    good, bad = L.quarantine(spoilt)
    return good.select(F.lit("none").alias("reason")).unionByName(bad.select(F.col("malformed").alias("reason"))).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY t, seq) AS rn FROM ({_AUDIT})),
f AS (SELECT 0::BIGINT AS rn, []::STRUCT(k VARCHAR, n BIGINT)[] AS held, 0::BIGINT AS n
  UNION ALL SELECT rn, CASE WHEN mine IS NOT NULL THEN held WHEN len(held) >= 40 THEN list_append(held[2:], {{'k': k, 'n': rn}}) ELSE list_append(held, {{'k': k, 'n': rn}}) END, coalesce(mine.n, rn)
  FROM (SELECT o.rn, o.session_id AS k, f.held, list_filter(f.held, lambda x: x.k = o.session_id)[1] AS mine FROM f JOIN o ON o.rn = f.rn + 1))
SELECT seq, array_to_string(list(event) OVER (PARTITION BY session_id, f.n ORDER BY t, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS context FROM o JOIN f ON f.rn = o.rn""")
def alert_context_bound(spark, sf_dir):
    """No more than 40 sessions are remembered, the one held longest goes first."""
    return L.recent_context(_audit_rows(spark, sf_dir), 5, 40).select("seq", F.array_join("context", ",").alias("context"))


# ---- gateway and sinks


@query(f"""WITH RECURSIVE o AS MATERIALIZED (SELECT event_id AS seq, (epoch_us(ts) // 1000) AS t, user_id || ' ' || props AS k, row_number() OVER (ORDER BY (epoch_us(ts) // 1000), event_id) AS rn FROM events),
f AS (SELECT 0::BIGINT AS rn, []::STRUCT(k VARCHAR, t BIGINT)[] AS held, false AS cached
  UNION ALL SELECT rn, CASE WHEN hit THEN held WHEN len(live) >= 100 THEN live ELSE list_append(live, {{'k': k, 't': t}}) END, hit
  FROM (SELECT *, len(list_filter(held, lambda x: x.k = p.k AND p.t - x.t <= {_CACHE})) > 0 AS hit, CASE WHEN len(other) >= 100 THEN list_filter(other, lambda x: p.t - x.t <= {_CACHE}) ELSE other END AS live
    FROM (SELECT o.rn, o.k, o.t, f.held, list_filter(f.held, lambda x: x.k <> o.k) AS other FROM f JOIN o ON o.rn = f.rn + 1) p))
SELECT seq, cached FROM o JOIN f ON f.rn = o.rn""")
def scan_cache_bound(spark, sf_dir):
    """All sessions share 100 copies: past their time they go when it is full; while it is full, a scan leaves no copy."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("session_id"), T.millis("ts").alias("ts_ms"), F.col("props").alias("content"))
    return H.repeated_scans(e, ttl_ms=_CACHE, most=100).select("seq", "cached")


@query("SELECT 'log' AS sink, count(*) AS n, count_if(event_type = 'click') AS loud FROM events UNION ALL SELECT 'ingest', count(*), count_if(event_type IN ('click', 'view')) FROM events UNION ALL SELECT 'broken', 0, 1")
def sinks_all(spark, sf_dir):
    """One batch of alerts to the log, to the ingest and to a sink that fails, which stops neither."""
    config = _alert_config(policy_count=1, write_count=1, disabled=())
    rows = L.build(L.decide(L.candidates(_kind_rows(spark, sf_dir).withColumn("trusted", F.lit(True)), config), config), config)
    path, failed = shared_path(spark, "sinks"), []

    def broken(batch, number):
        raise OSError("no such place")

    sinks = choose_sinks("both", lambda b, n: log_lines(b).write.parquet(f"{path}/log"), lambda b, n: ingest_rows(b).write.parquet(f"{path}/ingest"))
    write_each({"broken": broken, **sinks}, on_error=lambda name, why: failed.append(name))(rows, 0)
    log, ingest = spark.read.parquet(f"{path}/log"), spark.read.parquet(f"{path}/ingest")
    critical = F.array_contains("tags", "critical") | F.col("message").contains("frequencyEscalationTier2")
    return (
        log.select(F.lit("log").alias("sink"), F.col("level") == "error").toDF("sink", "loud").groupBy("sink").agg(F.count("*").alias("n"), F.count_if("loud").alias("loud"))
        .unionByName(ingest.select(F.lit("ingest").alias("sink"), (F.col("notify") & critical).alias("loud")).groupBy("sink").agg(F.count("*").alias("n"), F.count_if("loud").alias("loud")))
        .unionByName(spark.range(1).select(F.lit("broken").alias("sink"), F.lit(0).cast("bigint").alias("n"), F.lit(len(failed)).cast("bigint").alias("loud")))
    )


# ---- texts and objects made of the events

_SHAPE = "CASE event_id % 5 WHEN 0 THEN 'bell' || chr(7) WHEN 1 THEN '[[[[\"x\"]]]]' WHEN 2 THEN repeat('y', 100) WHEN 3 THEN '[[[[\"x\"]]]' ELSE props END"


@query(f"""SELECT event_id AS seq, event_id % 5 > 2 AS pass, CASE event_id % 5 WHEN 0 THEN '{SYNTACTIC}.structural.binary-content' WHEN 1 THEN '{SYNTACTIC}.structural.excessive-depth' WHEN 2 THEN '{SYNTACTIC}.structural.oversized-payload' ELSE '' END AS rules,
  CASE event_id % 5 WHEN 0 THEN 'Binary/control characters detected in text content' WHEN 1 THEN 'JSON depth 4 exceeds limit 3' WHEN 2 THEN 'Payload ' || octet_length(encode({_SHAPE})) || ' bytes exceeds limit 64' ELSE '' END AS flags FROM events""")
def prefilter_structural(spark, sf_dir):
    """Control characters, nesting and size; brackets that don't close are no JSON."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.expr(_SHAPE.replace(" || chr(7)", " || char(7)")).alias("content"))
    return prefilter(e, P.PrefilterConfig(max_payload_bytes=64, max_json_depth=3)).select("seq", F.col("pre.pass").alias("pass"), F.array_join("pre.rule_ids", ",").alias("rules"), F.array_join("pre.flags", "|").alias("flags"))


_SIDES = (
    C.Detector("note", "quoted", "low", '"k"'), C.Detector("note", "count", "critical", "[0-9]+"), C.Detector("note", "first", "high", '"k"', "outbound"), C.Detector("note", "num", "high", "[0-9]+", "outbound"),
)
_SAID = {"quoted": """'note/quoted (low): ""k""@1'""", "first": """'note/first (high): ""k""@1'""", "count": """'note/count (critical): "' || num || '"@6'""", "num": """'note/num (high): "' || num || '"@6'"""}


@query("WITH e AS (SELECT event_id AS seq, regexp_extract(props, '[0-9]+') AS num FROM events) " + " UNION ALL ".join(f"SELECT seq, '{side}' AS direction, {_SAID[a]} || ',' || {_SAID[b]} AS found FROM e" for side, a, b in (("inbound", "quoted", "count"), ("outbound", "first", "num"), ("both", "first", "count"))))
def scan_directions(spark, sf_dir):
    """Findings of one direction, of the other, and of both: at one place an outbound one wins if it is more severe."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("props").alias("content"))
    told = F.array_join(F.transform("findings", lambda f: F.concat(f.description, F.lit("@"), f.position.cast("string"))), ",")
    rows = [C.detect(e, P.ScannerConfig(direction=d), _SIDES).select("seq", F.lit(d).alias("direction"), told.alias("found")) for d in ("inbound", "outbound", "both")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_NOTE = "CASE event_type WHEN 'purchase' THEN 'mail a@b.example' WHEN 'error' THEN 'ignore previous instructions' END"


@query(f"""SELECT event_id AS seq, event_type <> 'error' AS pass, (event_type IN ('purchase', 'error'))::BIGINT AS n, '{{"user_id":' || user_id || ',"note":' || CASE event_type WHEN 'purchase' THEN '"mail [REDACTED]"' WHEN 'error' THEN '"[REDACTED]"' ELSE 'null' END || '}}' AS clean FROM events""")
def scan_objects(spark, sf_dir):
    """Objects are judged, searched and redacted as their JSON text, nulls included."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.struct("user_id", F.expr(_NOTE).alias("note")).alias("content"))
    made = C.scan_and_sanitize(prefilter(e))
    return made.select("seq", F.col("pre.pass").alias("pass"), F.size("findings").cast("bigint").alias("n"), F.col("sanitized.content").alias("clean"))


@query("SELECT event_id AS seq, event_id % 3 > 0 AS parsed, CASE WHEN event_id % 3 > 0 THEN regexp_extract(props, '[0-9]+')::BIGINT ELSE -1 END AS k, CASE WHEN event_id % 3 > 0 THEN props ELSE left(props, 3) END AS text FROM events")
def json_fallback(spark, sf_dir):
    """A text that is no JSON stays as it is."""
    x = F.when(F.col("event_id") % 3 > 0, F.col("props")).otherwise(F.left("props", F.lit(3)))
    v = J.parse_or_text(F.col("x"))
    made = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), x.alias("x")).select("seq", v.alias("v"))
    return made.select("seq", F.col("v.json").isNotNull().alias("parsed"), F.coalesce(F.try_variant_get("v.json", "$.k", "bigint"), F.lit(-1).cast("bigint")).alias("k"), F.col("v.text").alias("text"))


@query("SELECT event_id AS seq, 'kind: ' || event_type || ', Token: [REDACTED], n: ' || event_id AS shown FROM events")
def tool_params_shown(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    params = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("Token"), F.col("props"), F.lit("n"), F.col("event_id").cast("string"))
    return e.select(F.col("event_id").alias("seq"), E.shown_params(params).alias("shown"))


# ---- settings

_CHECKS = {
    "depth 0": (lambda: P.PrefilterConfig(max_json_depth=0), True), "depth 1001": (lambda: P.PrefilterConfig(max_json_depth=1001), True), "depth 1000": (lambda: P.PrefilterConfig(max_json_depth=1000), False),
    "payload infinite": (lambda: P.PrefilterConfig(max_payload_bytes=float("inf")), True), "schema key": (lambda: P.SchemaConfig(schemas=(("a:b:c", P.ToolSchema((("one", P.Variant()),))),)), True),
    "schema empty": (lambda: P.SchemaConfig(schemas=(("a:b", P.ToolSchema(())),)), True), "schema type": (lambda: P.SchemaConfig(schemas=(("a:b", P.ToolSchema((("one", P.Variant(fields=(("k", "int"),))),))),)), True),
    "thresholds equal": (lambda: P.FrequencyConfig(thresholds=(1, 1, 2)), True), "half life 0": (lambda: P.FrequencyConfig(half_life_ms=0), True), "rolling 1.5": (lambda: P.FrequencyConfig(rolling_threshold=1.5), True),
    "creations 0": (lambda: P.FrequencyConfig(max_new_sessions_per_minute=0), True), "weight negative": (lambda: P.FrequencyConfig(weights=MappingProxyType({"a": -1.0})), True), "weights own": (lambda: P.FrequencyConfig(weights=MappingProxyType({"a": 1.0})), False),
    "verbosity unknown": (lambda: P.AuditConfig(verbosity="loud"), True), "verbosity maximum": (lambda: P.AuditConfig(verbosity="maximum"), False), "suppression negative": (lambda: P.AlertConfig(suppression_minutes=-1), True),
    "suppression 0": (lambda: P.AlertConfig(suppression_minutes=0), False), "rate 0": (lambda: P.AlertConfig(per_minute=0), True), "context negative": (lambda: P.AlertConfig(context=-1), True), "threshold unknown": (lambda: P.ScannerConfig(threshold="odd"), True),
    "profile unknown": (lambda: P.resolve_profile("nobody"), True), "profile built in": (lambda: P.resolve_profile(P.Profile("general")), True), "profile descending": (lambda: P.resolve_profile(P.Profile("own", thresholds=(3, 2, 1))), True),
    "profile over another": (lambda: P.resolve_profile(P.Profile("own"), base="admin"), False), "option unknown": (lambda: P.from_options(P.HostConfig, {"volume": 11}), True), "option known": (lambda: P.from_options(P.HostConfig, {"exempt_tools": ["ping"]}), False),
}


def _refused(make) -> bool:
    try:
        make()
    except ValueError:
        return True
    return False


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', {str(bad).lower()})" for name, (_, bad) in _CHECKS.items()) + ") AS t(setting, refused)")
def settings_checked(spark, sf_dir):
    return spark.createDataFrame([(name, _refused(make)) for name, (make, _) in _CHECKS.items()], "setting string, refused boolean")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p.name}', {int((p.thresholds or (15, 30, 50))[0])}, {len(p.suppress)}, {10 + dict(p.weights).get(f'{NAMESPACE}.credential.*', 10.0) - 10})" for p in P.PROFILES.values()) + ") AS t(profile, first_tier, suppressed, token_weight)")
def profiles_applied(spark, sf_dir):
    """What each built-in profile makes of the settings: the first tier, suppressed rules, and a leaked token's weight."""
    rows = []
    for p in P.PROFILES.values():
        c = P.PipelineConfig().with_profile(P.resolve_profile(p.name))
        w = Q.weight(F.lit(f"{NAMESPACE}.credential.token"), c.frequency)
        rows.append(spark.range(1).select(F.lit(p.name).alias("profile"), F.lit(int(c.frequency.thresholds[0])).alias("first_tier"), F.lit(len(c.prefilter.suppress)).alias("suppressed"), w.alias("token_weight")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
