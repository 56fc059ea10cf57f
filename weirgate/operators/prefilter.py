"""The syntactic rules: one struct column with ordered rule ids, their texts and the verdict.

Patterns see the normalised text, structural and base64 checks the raw one. An oversized payload is judged by its size alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import text as T
from ..plans.config import SYNTACTIC, PrefilterConfig

_LINE = r"(?:\A|(?<=[\n\r\x{2028}\x{2029}]))"
# Rule names in the order in which they are reported, the phrases of which one must be there whatever its case,
# and the pattern that must match as well.
INJECTION = (
    ("ignore-previous", ("ignore previous instructions",), None),
    ("ignore-all", ("ignore all instructions",), None),
    ("disregard", ("disregard your",), None),
    ("you-are-now", ("you are now",), None),
    ("new-instructions", ("new instructions",), r"(?i)new instructions[\s\x{1680}\x{2028}\x{2029}]*:"),
    ("system-override", ("system override",), None),
    ("system-prefix", ("system:",), _LINE + "SYSTEM:"),
    ("inst-delimiter", ("[inst]", "</inst>"), None),
)
ROLE_TRIGGER = ("you are a", "act as", "pretend you are", "roleplay as")
CAPABILITY_GRANT = ("no restrictions", "no limits", "without filters", "dan mode", "developer mode")
BINARY = r"[\x01-\x08\x0E-\x1F]"
BASE64 = "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}"  # where a run of 40 or more begins

TAXONOMY = tuple(f"{SYNTACTIC}.{x}" for x in ("structural.oversized-payload", "structural.excessive-depth", "structural.binary-content", *(f"injection.{n}" for n, _, _ in INJECTION), "injection.role-switch-capability", "injection.role-switch-only", "encoding.invisible-chars", "encoding.base64-in-text", "encoding.homoglyph-substitution", "encoding.rtl-override"))


def _says(lower: Column, phrases: tuple[str, ...]) -> Column:
    """Plain searches in the lower-cased text: a fraction of what patterns cost."""
    out = F.contains(lower, F.lit(phrases[0]))
    for p in phrases[1:]:
        out = out | F.contains(lower, F.lit(p))
    return out


def prefilter(df: DataFrame, config: PrefilterConfig = PrefilterConfig(), content: str = "content", out: str = "pre") -> DataFrame:
    """Adds struct(pass, rule_ids, flags). A null content counts as empty; a content of another type is taken as JSON text."""
    df = df.withColumn("__raw", F.coalesce(J.stringify(F.col(content), df.schema[content].dataType), F.lit("")))
    x = F.col("__raw")
    size = F.octet_length(x)
    over = size > config.max_payload_bytes
    # Oversized texts are emptied before they are normalised: nothing further is asked of them.
    df = df.withColumn("__x", F.when(over, F.lit("")).otherwise(x))
    t, plain = F.col("__x"), F.col("__plain")
    df = df.withColumn("__plain", T.is_plain(t)).withColumn("__stripped", F.when(plain, t).otherwise(T.strip_invisible(t)))
    df = df.withColumn("__fold", T.folded(F.col("__stripped"), plain)).withColumn("__norm", F.when(plain, t).otherwise(T.map_look_alikes(F.col("__fold"))))
    # Of normalised text, lower case makes no new ASCII letters: the search equals one that ignores ASCII case.
    df = df.withColumn("__low", F.lower("__norm"))
    n, low = F.col("__norm"), F.col("__low")
    suppressed = set(config.suppress)
    df = df.withColumns({f"__r{i}": _says(low, phrases) if pattern is None else _says(low, phrases) & n.rlike(pattern) for i, (_, phrases, pattern) in enumerate(INJECTION)} | {"__trigger": _says(low, ROLE_TRIGGER)}).withColumn("__grant", F.col("__trigger") & _says(low, CAPABILITY_GRANT))
    hits = [(f"injection.{name}", F.col(f"__r{i}")) for i, (name, _, _) in enumerate(INJECTION)] + [("injection.role-switch-capability", F.col("__grant"))]
    injected = F.lit(False)
    for _, c in hits:
        injected = injected | c
    gone = F.length(t) - F.length("__stripped")
    deep = J.excessive_depth(t, config.max_json_depth)
    # (name, hit, fails, text)
    rules: list[tuple[str, Column, bool | Column, Column]] = [
        ("structural.oversized-payload", over, True, F.format_string(f"Payload %d bytes exceeds limit {config.max_payload_bytes}", size)),
        ("structural.excessive-depth", deep, True, F.format_string(f"JSON depth %d exceeds limit {config.max_json_depth}", J.depth(t))),
        ("structural.binary-content", t.rlike(BINARY), True, F.lit("Binary/control characters detected in text content")),
    ]
    for name, c in hits[:-1]:
        rules.append((name, c, f"{SYNTACTIC}.{name}" not in suppressed, F.lit(f"Injection pattern matched: {SYNTACTIC}.{name}")))
    rules += [
        ("injection.role-switch-capability", F.col("__grant"), f"{SYNTACTIC}.injection.role-switch-capability" not in suppressed, F.lit("Role-switch with capability grant detected")),
        ("injection.role-switch-only", F.col("__trigger") & ~F.col("__grant"), False, F.lit("Role-switch trigger detected (flag only)")),
        ("encoding.invisible-chars", gone > 0, injected, F.format_string("%d invisible/zero-width character(s) stripped before analysis", gone)),
        ("encoding.base64-in-text", t.rlike(BASE64), False, F.lit("Potential base64-encoded content detected in text field")),
        ("encoding.homoglyph-substitution", ~plain & (n != F.col("__stripped")) & injected, False, F.lit("Unicode confusable characters normalized (homoglyph/fullwidth/compatibility substitution)")),
        ("encoding.rtl-override", ~plain & T.rtl_overrides(t), False, F.lit("RTL/LTR override characters detected")),
    ]
    df = df.withColumns({f"__h{i}": hit for i, (_, hit, _, _) in enumerate(rules)})
    failed = F.lit(False)
    for i, (_, _, fails, _) in enumerate(rules):
        if fails is not False:
            failed = failed | (F.col(f"__h{i}") if fails is True else F.col(f"__h{i}") & fails)
    ids = F.array_compact(F.array(*(F.when(F.col(f"__h{i}"), F.lit(f"{SYNTACTIC}.{name}")) for i, (name, _, _, _) in enumerate(rules))))
    flags = F.array_compact(F.array(*(F.when(F.col(f"__h{i}"), text) for i, (_, _, _, text) in enumerate(rules))))
    made = df.withColumn(out, F.struct((~failed).alias("pass"), ids.alias("rule_ids"), flags.alias("flags")))
    return made.drop("__raw", "__x", "__plain", "__stripped", "__fold", "__norm", "__low", "__trigger", "__grant", *(f"__r{i}" for i in range(len(INJECTION))), *(f"__h{i}" for i in range(len(rules))))


def passes(rule_ids: Column, suppress: tuple[str, ...] = ()) -> Column:
    """The verdict that a text with these rule hits gets where `suppress` is set: the texts need not be read again for each profile."""
    named = lambda *xs: F.array(*(F.lit(f"{SYNTACTIC}.{x}") for x in xs))
    injections = [f"injection.{name}" for name, _, _ in INJECTION] + ["injection.role-switch-capability"]
    failing = ["structural.oversized-payload", "structural.excessive-depth", "structural.binary-content", *(x for x in injections if f"{SYNTACTIC}.{x}" not in suppress)]
    hidden = F.array_contains(rule_ids, f"{SYNTACTIC}.encoding.invisible-chars") & F.arrays_overlap(rule_ids, named(*injections))
    return ~(F.arrays_overlap(rule_ids, named(*failing)) | hidden)
