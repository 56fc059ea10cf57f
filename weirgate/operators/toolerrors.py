"""Tool errors: categories, severities, advice to the caller, and a breaker that opens after consecutive failures."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncated
from .fold import keyed_fold

MAX_ATTEMPTS = 3
MAX_ADVICE = 800

# Tools that get advice, by kind; names of parameters that are never shown; patterns of error categories, in order.
KINDS = {"retrieval": ("memory_search", "memory_query", "memory_traverse", "memory_fetch"), "mutation": ("memory_ingest", "memory_link", "memory_delete"), "utility": ("memory_list", "memory_sources", "memory_status", "memory_embed_text", "memory_evaluate_process", "memory_changes")}
SENSITIVE = ("token", "password", "apikey", "api_key", "secret", "authorization", "credentials", "bearer", "session_token")
CATEGORIES = (
    ("timeout", r"(?i)timeout|timed?\s*out|etimedout|deadline\s*exceeded"),
    ("rate_limit", r"(?i)429|rate\s*limit|too\s*many\s*requests|throttle"),
    ("auth_failure", r"(?i)401|403|unauthorized|forbidden|auth|credential"),
    ("server_unreachable", r"(?i)econnrefused|enotfound|eai_again|ehostunreach|network\s*error|connection\s*refused|fetch\s*failed"),
    ("validation", r"(?i)invalid|required|missing|must\s*be|must\s*have|schema|expected"),
)

# Advice, by tool, by kind of tool and in general; {tool}, {error} and {params} stand for the call's own.
BY_TOOL = (
    ("memory_search", "validation", r"(?i)source_type|source_system", "INVALID PARAMS for memory_search: {params}. memory_search does not support source_type or source_system filtering in query params. Use memory_query for filtered retrieval by type, tags, or metadata. memory_search is for semantic/fuzzy search by query text."),
    ("memory_query", "validation", r"(?i)metadata_filter|operator|\$gt|\$gte|\$lt|\$lte|\$ne|\$in", "INVALID PARAMS for memory_query: {params}. metadata_filter supports comparison operators: $gt, $gte, $lt, $lte, $ne, $in. Ensure operator values match expected types (numbers for $gt/$lt, arrays for $in)."),
    ("memory_traverse", "validation", r"(?i)depth", "INVALID PARAMS for memory_traverse: {params}. depth must be 1-3. For deep relationship exploration, chain multiple traverse calls at depth 1."),
    ("memory_evaluate_process", "timeout", "", "TOOL TIMEOUT: memory_evaluate_process is long-running (up to 5 minutes). This timeout may be expected. Retry with same params. Inform user this operation takes time."),
)
BY_KIND = (
    ("retrieval", "timeout", False, "TOOL TIMEOUT: {tool} timed out. RECOVERY: (1) Retry with narrower query (reduce max_results, add time_after/time_before filters). (2) If query-based, try memory_query with source_type/tags filters instead. (3) If still failing, skip retrieval and respond from available context."),
    ("retrieval", "validation", True, "INVALID PARAMS for {tool}: {params}. ERROR: {error}. RECOVERY: Fix parameter and retry. NOTE: memory_search uses semantic query; use memory_query for filtered retrieval by source_type, tags, or metadata."),
    ("mutation", "timeout", False, "TOOL TIMEOUT: {tool} timed out. RECOVERY: (1) Retry once — mutation may have completed server-side (idempotent by content hash for ingest). (2) If still failing, inform user the operation may need manual completion."),
    ("mutation", "validation", True, "INVALID PARAMS for {tool}: {params}. ERROR: {error}. NOTE: memory_ingest requires either text or image_data (mutually exclusive). memory_link requires both source_id and target_id as valid UUIDs."),
    ("utility", "timeout", True, "TOOL TIMEOUT: {tool} timed out. RECOVERY: These are lightweight read operations. Timeout likely indicates MCP server issue. Retry once. If failing, inform user and proceed without this data."),
)
GENERAL = (
    ("timeout", True, "TOOL TIMEOUT: {tool} did not respond in time. Retry once with same params."),
    ("timeout", False, "TOOL TIMEOUT: {tool} timed out. ERROR: {error}. RECOVERY: (1) Retry once with same params. (2) If retry fails, inform the user."),
    ("rate_limit", True, "RATE LIMITED: {tool} returned 429. Wait briefly, then retry once."),
    ("rate_limit", False, "RATE LIMITED: {tool} returned 429. RECOVERY: (1) Wait briefly and retry. (2) If still failing, inform the user."),
    ("auth_failure", False, "AUTH FAILURE: {tool} returned authentication error. CAUSE: MCP server credentials may have expired. RECOVERY: Inform the user that {tool} is unavailable due to auth failure. Do not retry."),
    ("server_unreachable", False, "SERVER UNREACHABLE: {tool} MCP server is not responding. CAUSE: Server may be down or network interrupted. RECOVERY: Inform the user that {tool} is unavailable."),
    ("validation", False, "INVALID PARAMS for {tool}: {params}. ERROR: {error}. RECOVERY: Fix parameter and retry."),
    ("unknown", False, "TOOL FAILURE: {tool} returned an error. ERROR: {error}. RECOVERY: (1) Retry once with same params. (2) If retry fails, inform the user."),
)
TERMINAL = "ATTEMPT {attempt} OF 3 — CIRCUIT OPEN. {tool} has failed {attempt} consecutive times ({category}). Do NOT retry. Inform the user that {tool} is currently unavailable and suggest manual intervention."


def tool_of(name: Column) -> Column:
    """Without the server's prefix, if what remains is a tool that gets advice."""
    known = [t for ts in KINDS.values() for t in ts]
    bare = F.substring_index(name, "__", -1)
    return F.when(bare.isin(*known), bare).otherwise(name)


def kind_of(tool: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, tools in KINDS.items():
        out = F.when(tool.isin(*tools), kind).otherwise(out)
    return out


def category_of(error: Column) -> Column:
    out = F.lit("unknown")
    for name, pattern in reversed(CATEGORIES):
        out = F.when(error.rlike(pattern), name).otherwise(out)
    return out


def severity_of(category: Column, attempt: Column, cut: Column) -> Column:
    return (
        F.when(cut, "recoverable").when(attempt >= MAX_ATTEMPTS, "terminal").when(category == "auth_failure", "recoverable")
        .when((category == "server_unreachable") & (attempt >= 2), "terminal").when(category.isin("timeout", "rate_limit") & (attempt == 1), "transient").otherwise("recoverable")
    )


def shown_params(params: Column) -> Column:
    """key: value pairs of a map, joined by commas; values are JSON text, sensitive ones hidden."""
    return F.array_join(F.transform(F.map_entries(params), lambda e: F.concat(e.key, F.lit(": "), F.when(F.lower(e.key).isin(*SENSITIVE), "[REDACTED]").otherwise(e.value))), ", ")


def _fill(template: str, **values: Column) -> Column:
    import re

    parts = re.split(r"\{(tool|error|params|attempt|category)\}", template)
    return F.concat(*(values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def advice(rows: DataFrame) -> DataFrame:
    """Adds category, severity, source and advice. rows: tool_name, error_text, attempt, params (map), cut (text was cut off)."""
    tool, error, attempt = F.col("__tool"), F.coalesce("error_text", F.lit("")), F.col("attempt")
    df = rows.withColumn("__tool", tool_of(F.col("tool_name"))).withColumn("category", category_of(error))
    df = df.withColumn("severity", severity_of(F.col("category"), attempt, F.coalesce("cut", F.lit(False)))).withColumn("__p", F.coalesce(shown_params(F.col("params")), F.lit("")))
    category, severity = F.col("category"), F.col("severity")
    fill = lambda t: _fill(t, tool=tool, error=error, params=F.col("__p"), attempt=attempt, category=category)
    transient = severity == "transient"
    made = lambda source, text: F.struct(F.lit(source).alias("source"), text.alias("text"))
    out = F.when(severity == "terminal", made("global", fill(TERMINAL)))
    for name, c, pattern, text in BY_TOOL:
        out = out.when((tool == name) & (category == c) & (error.rlike(pattern) if pattern else F.lit(True)), made("tool", fill(text)))
    for k, c, also_first, text in BY_KIND:
        out = out.when((kind_of(tool) == k) & (category == c) & (F.lit(True) if also_first else ~transient), made("category", fill(text)))
    for c, first, text in GENERAL:
        out = out.when((category == c) & (transient if first else F.lit(True)), made("global", fill(text)))
    return df.withColumn("__a", out).withColumns({"source": F.col("__a.source"), "advice": truncated(F.col("__a.text"), MAX_ADVICE)}).drop("__a", "__tool", "__p")


def is_error(flag: Column, status: Column, lead: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(status == "error", F.lit(False)) | F.coalesce(lead.startswith("Error:"), F.lit(False))


def attempts(rows: DataFrame, error: str = "is_error") -> DataFrame:
    """Adds attempt (failures in a row up to this one, 0 for a success) and blocked (the breaker was open before it).

    rows: session_id, tool_name, ts_ms, seq and, for a session's end, kind 'reset'. Each success or reset starts an island.
    """
    ends = F.col("kind").isin("reset", "session_end", "before_reset") if "kind" in rows.columns else F.lit(False)
    w = Window.partitionBy("session_id", "tool_name").orderBy("ts_ms", "seq")
    df = rows.withColumn("__island", F.sum((ends | ~F.col(error)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("session_id", "tool_name", "__island").orderBy("ts_ms", "seq")
    df = df.withColumn("attempt", F.sum((F.col(error) & ~ends).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return df.withColumn("blocked", F.coalesce(F.lag("attempt").over(w), F.lit(0)) >= MAX_ATTEMPTS).drop("__island")


def enriched(rows: DataFrame) -> DataFrame:
    """Tool name from the message's own fields, error text from its details or its blocks: content_tool, message_tool, message_name, blocks (array), details_error."""
    joined = F.array_join("blocks", " ")
    own = (F.length(joined) == 0) | joined.startswith("{")
    return rows.withColumns({"tool_name": F.coalesce("content_tool", "message_tool", "message_name"), "error_text": F.when(own & F.col("details_error").isNotNull(), F.col("details_error")).otherwise(joined)})


def with_enrichment(rows: DataFrame) -> DataFrame:
    """Adds the blocks with the advice after them, and the details: of advised rows with blocks (array), attempt and cut.

    A text that was cut off can't be judged terminal; from the third attempt on the advice ends in a warning.
    """
    late = F.coalesce("cut", F.lit(False)) & (F.col("attempt") >= MAX_ATTEMPTS)
    warning = F.concat(F.lit(" WARNING: This is attempt "), F.col("attempt").cast("string"), F.lit(f" of {MAX_ATTEMPTS}. The next invocation of "), tool_of(F.col("tool_name")), F.lit(" will be blocked."))
    text = F.when(late, truncated(F.concat("advice", warning), MAX_ADVICE)).otherwise(F.col("advice"))
    details = F.struct(tool_of(F.col("tool_name")).alias("tool_name"), F.col("severity").alias("severity"), F.col("category").alias("error_category"), F.col("source").alias("template_source"), "attempt", F.lit(MAX_ATTEMPTS).alias("max_attempts"))
    return rows.withColumns({"blocks": F.array_append("blocks", text), "enricher": details})


def breaker_reason(rows: DataFrame) -> DataFrame:
    """Adds reason where the breaker was open before the call. rows: tool_name, blocked, attempt (failures so far), error_text (the last one's)."""
    tool = tool_of(F.col("tool_name"))
    text = F.concat(tool, F.lit(" has failed "), F.col("attempt").cast("string"), F.lit(" consecutive times ("), category_of(F.coalesce("error_text", F.lit(""))), F.lit("). Inform the user that "), tool, F.lit(" is currently unavailable and suggest checking the MCP server or network connectivity."))
    return rows.withColumn("reason", F.when(F.col("blocked"), text))


# ---- whole sessions of tool events

#: Where a text was cut off before it came here, it says so.
CUT_MARK = "... [truncated]"


def _text(v: Column, path: str) -> Column:
    """The string at a path of a variant; null if there is none, it is empty or no string."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.nullif(F.try_variant_get(v, path, "string"), F.lit("")))


def read_messages(events: DataFrame) -> DataFrame:
    """Adds what a tool's result says of itself, of its JSON text `message`: tool, flagged, failed (by its details), lead, blocks, error_text, details_error."""
    v = F.try_parse_json("message")
    df = events.withColumn("__v", v).withColumn("__c", F.try_variant_get("__v", "$.content", "variant"))
    kind = F.coalesce(F.schema_of_variant("__c"), F.lit(""))
    df = df.withColumn("__b", F.when(kind.startswith("ARRAY"), F.try_variant_get("__c", "$", "array<variant>")))
    names = lambda x: F.coalesce(_text(x, "$.name"), _text(x, "$.toolName"))
    of_blocks = F.get(F.filter(F.transform("__b", names), lambda n: n.isNotNull()), 0)
    of_object = F.when(kind.startswith("OBJECT"), names(F.col("__c")))
    whole = F.when(kind == "STRING", F.try_variant_get("__c", "$", "string"))
    is_text = lambda b: F.schema_of_variant(F.try_variant_get(b, "$.text", "variant")) == "STRING"
    texts = F.transform(F.filter("__b", lambda b: F.coalesce(is_text(b), F.lit(False))), lambda b: F.try_variant_get(b, "$.text", "string"))
    first = F.when(F.size("__b") > 0, F.try_variant_get(F.get("__b", 0), "$.text", "string"))
    joined = F.coalesce(whole, F.array_join(texts, " "), F.lit(""))
    details = _text(F.col("__v"), "$.details.error")
    return df.withColumns({
        "tool": tool_of(F.coalesce(F.nullif("tool_name", F.lit("")), of_blocks, of_object, _text(F.col("__v"), "$.toolName"), _text(F.col("__v"), "$.name"))),
        "flagged": F.coalesce(F.try_variant_get("__v", "$.isError", "boolean"), F.lit(False)),
        "failed": F.coalesce(_text(F.col("__v"), "$.details.status") == "error", F.lit(False)),
        "lead": F.coalesce(whole, first, F.lit("")), "blocks": F.coalesce(texts, F.array(F.coalesce(whole, F.lit("")))), "details_error": details,
        "error_text": F.when(details.isNotNull() & ((joined == "") | joined.startswith("{")), details).otherwise(joined),
    }).drop("__v", "__c", "__b")


def remediation_step(known: frozenset[str]):
    """Counters of one session's tools. A flagged result was counted when its call came back; one that only its text or details
    give away is counted here. Without an earlier call, a flagged result is a first attempt that leaves no counter."""

    def step(state, row):
        state = state or {}
        kind, tool = row["kind"], row["tool"]
        if kind in ("session_end", "before_reset"):
            return {}, None
        if tool not in known:
            return state, None
        held = state.get(tool)
        out = {"attempt": held["n"] if held else 0, "last_error": held["error"] if held else "", "last_params": held["params"] if held else None, "blocked": False, "enrich": False}
        if kind == "after_tool_call":
            bad = row["error"] is not None
            state[tool] = {"n": out["attempt"] + bad, "error": row["error"] if bad else out["last_error"], "params": row["params"]}
            return state, None
        if kind == "before_tool_call":
            return state, out | {"blocked": out["attempt"] >= MAX_ATTEMPTS}
        if kind != "tool_result_persist" or row["synthetic"]:
            return state, None
        by_text = not row["flagged"] and not row["failed"] and row["lead"].startswith("Error:")
        if not (row["flagged"] or row["failed"] or by_text):
            if held:
                state[tool] = held | {"n": 0, "error": ""} if held["n"] else held
            return state, None
        if row["failed"] or by_text:
            held = state[tool] = {"n": out["attempt"] + 1, "error": row["details_error"] or "", "params": out["last_params"]}
        return state, out | {"attempt": held["n"] if held else 1, "last_error": held["error"] if held else "", "enrich": True}

    return step


_REMEDY = [("attempt", pa.int32(), "int"), ("last_error", pa.string(), "string"), ("last_params", pa.string(), "string"), ("blocked", pa.bool_(), "boolean"), ("enrich", pa.bool_(), "boolean")]


def remediate(events: DataFrame) -> DataFrame:
    """Calls that the breaker judged, and failed results with their advice, out of tool events in order.

    events: session_id, ts_ms, seq, kind (after_tool_call, tool_result_persist, before_tool_call, session_end, before_reset),
    tool_name, params (JSON text), error, message (JSON text), synthetic. Returns session_id, ts_ms, seq, kind, tool_name, attempt,
    blocked, reason, blocks and enricher; the last two are null for calls. Events without a session are left out. A session
    holds one counter for each tool that gets advice, so a hot session streams through in constant memory.
    """
    df = read_messages(events.where("session_id is not null")).withColumn("synthetic", F.coalesce("synthetic", F.lit(False)))
    known = frozenset(t for ts in KINDS.values() for t in ts)
    keep = ["session_id", "ts_ms", "seq", "kind", "tool", "blocks", "error_text"]
    rows = df.select(*keep, "flagged", "failed", "lead", "details_error", "error", "params", "synthetic")
    made = keyed_fold(rows, ["session_id"], ["ts_ms", "seq"], remediation_step(known), _REMEDY, keep).withColumnRenamed("tool", "tool_name")
    calls = breaker_reason(made.where("not enrich").withColumn("error_text", F.col("last_error")))
    given = F.try_parse_json("last_params").try_cast("map<string,variant>")
    shown = made.where("enrich").withColumns({"params": F.transform_values(given, lambda _, x: F.to_json(x)), "cut": F.contains("error_text", F.lit(CUT_MARK))})
    told = with_enrichment(advice(shown)).withColumn("reason", F.lit(None).cast("string"))
    out = ["session_id", "ts_ms", "seq", "kind", "tool_name", "attempt", "blocked", "reason"]
    return told.select(*out, "blocks", "enricher").unionByName(calls.select(*out), allowMissingColumns=True)
