"""Validation of tool outputs against declared schemas, as expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..plans.config import SchemaConfig, ToolSchema, Variant

RULES = ("schema.invalid-key", "schema.no-schema-registered", "schema.type-mismatch", "schema.missing-field", "schema.misconfiguration", "schema.extra-field")


def _violation(rule: str, text: Column | str) -> Column:
    return F.struct(F.lit(rule).alias("rule"), (F.lit(text) if isinstance(text, str) else text).alias("text"))


_NONE = "array<struct<rule:string,text:string>>"


def _none() -> Column:
    return F.array().cast(_NONE)


def _some(*found: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c, v) for c, v in found))) if found else _none()


def _variant(variant: Variant, v: Column, keys: Column, discriminant: str | None) -> Column:
    """Violations of the required fields, then of the types, then extra fields."""
    has = lambda f: F.array_contains(keys, f)
    missing = _some(*((~has(f), _violation("schema.missing-field", f"missing required field {f}")) for f in variant.required))
    kind = lambda f: J.type_of(F.try_variant_get(v, f"$['{f}']", "variant"))
    wrong = _some(*((has(f) & (kind(f) != t), _violation("schema.type-mismatch", F.concat(F.lit(f"field {f}: expected {t}, got "), kind(f)))) for f, t in variant.fields))
    if variant.allow_extra:
        return F.concat(missing, wrong)
    declared = sorted({*variant.required, *(f for f, _ in variant.fields), *([discriminant] if discriminant else [])})
    extra = F.transform(F.array_except(keys, F.array(*map(F.lit, declared)) if declared else F.array().cast("array<string>")), lambda k: _violation("schema.extra-field", F.concat(F.lit("undeclared field "), k)))
    return F.concat(missing, wrong, extra)


def _against(schema: ToolSchema, v: Column, keys: Column) -> Column:
    body: Column
    if schema.discriminant is None:
        body = F.array(_violation("schema.misconfiguration", "more than one variant and no discriminant")) if len(schema.variants) != 1 else _variant(schema.variants[0][1], v, keys, None)
    else:
        d = schema.discriminant
        field = F.try_variant_get(v, f"$['{d}']", "variant")
        name = F.try_variant_get(v, f"$['{d}']", "string")
        body = F.array(_violation("schema.type-mismatch", F.concat(F.lit(f"unknown value of {d}: "), F.coalesce(name, F.lit("")))))
        for value, variant in reversed(schema.variants):
            body = F.when(name == value, _variant(variant, v, keys, d)).otherwise(body)
        body = F.when(~F.array_contains(keys, d), F.array(_violation("schema.missing-field", f"missing discriminant {d}"))).when(J.type_of(field) != "string", F.array(_violation("schema.type-mismatch", f"discriminant {d} is no string"))).otherwise(body)
    return F.when(J.type_of(v) != "object", F.array(_violation("schema.type-mismatch", F.concat(F.lit("expected object, got "), J.type_of(v))))).otherwise(body)


def validate(df: DataFrame, config: SchemaConfig, content="content", server="server_name", tool="tool_name", source="source", out="schema") -> DataFrame:
    """Adds struct(pass, rule_ids, violations), null where a message is no tool output; text that is no JSON counts as a string."""
    empty = F.array().cast("array<string>")
    applies = (F.col(source) == "mcp") & F.col(server).isNotNull() & F.col(tool).isNotNull()
    if not config.enabled:
        return df.withColumn(out, F.when(applies, F.struct(F.lit(True).alias("pass"), empty.alias("rule_ids"), empty.alias("violations"))))
    valid = J.is_json(F.col(content))
    df = df.withColumn("__v", F.when(valid, F.try_parse_json(F.col(content))).otherwise(F.try_parse_json(F.lit('"text"'))))
    # Keys in first order, each once.
    df = df.withColumn("__k", F.coalesce(F.when(valid, F.array_distinct(F.json_object_keys(F.col(content)))), empty))
    v, keys, key = F.col("__v"), F.col("__k"), F.concat_ws(":", F.col(server), F.col(tool))
    unregistered = F.array(_violation("schema.no-schema-registered", "no schema registered"))
    if config.strict:
        unregistered = F.when(J.type_of(v).isin("object", "array"), unregistered).otherwise(F.array(_violation("schema.type-mismatch", F.concat(F.lit("expected object or array, got "), J.type_of(v)))))
    found = unregistered
    for name, schema in reversed(config.schemas):
        found = F.when(key == name, _against(schema, v, keys)).otherwise(found)
    bad_key = F.contains(F.col(server), F.lit(":")) | F.contains(F.col(tool), F.lit(":"))
    found = F.when(bad_key, F.array(_violation("schema.invalid-key", "server or tool name holds a colon"))).otherwise(found)
    df = df.withColumn("__f", found)
    rules = F.array_distinct(F.transform("__f", lambda f: f.rule))
    result = F.struct(F.forall("__f", lambda f: f.rule == "schema.no-schema-registered").alias("pass"), rules.alias("rule_ids"), F.transform("__f", lambda f: f.text).alias("violations"))
    return df.withColumn(out, F.when(applies, result)).drop("__v", "__k", "__f")
