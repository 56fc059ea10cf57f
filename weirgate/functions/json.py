"""JSON text as columns: validity, nesting depth, types, keys."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


def is_json(x: Column) -> Column:
    """Whether the whole text is one JSON value. The parser ignores what follows a value, so the text is tried inside brackets of both kinds."""
    listed = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), x, F.lit("}")))
    one = F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.coalesce(x.isNotNull() & keyed.isNotNull() & one, F.lit(False))


def depth(x: Column) -> Column:
    """Deepest nesting of brackets outside string literals; 0 for scalars."""
    bare = F.regexp_replace(x, r'"(?:[^"\\]|\\.)*+"', "")
    brackets = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    step = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def move(acc: Column, c: Column) -> Column:
        now = acc.now + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc.most, now).alias("most"))

    return F.when(x.rlike(r"^[ \t\r\n]*[\[{]"), F.aggregate(brackets, step, move, lambda acc: acc.most)).otherwise(F.lit(0))


#: Below this the parser reads any nesting.
PARSED_DEPTH = 500


def excessive_depth(x: Column, most: int) -> Column:
    """Valid JSON that is nested deeper than `most`. Validity is only asked where the brackets go that deep."""
    d = depth(x)
    balanced = F.length(F.regexp_replace(x, r"[^\[{]", "")) == F.length(F.regexp_replace(x, r"[^\]}]", ""))
    return F.when(d > most, F.when(d > PARSED_DEPTH, balanced).otherwise(is_json(x))).otherwise(False)


def type_of(v: Column) -> Column:
    """string, number, boolean, object, array or null, of a VARIANT; an absent value counts as null."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (s == "VOID"), "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean")
        .when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").otherwise("number")
    )


def parse_or_text(x: Column) -> Column:
    """struct(json, text): the value if the text is JSON, else null beside the text itself."""
    return F.struct(F.when(is_json(x), F.try_parse_json(x)).alias("json"), x.alias("text"))


#: Levels of an object that its text keeps, and what stands for those below.
KEPT_DEPTH, CUT = 32, "[Depth limit]"
_PART = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]')


def cut_text(text: str, most: int = KEPT_DEPTH) -> str:
    """JSON text with every object or array below `most` levels replaced by a mark."""
    out, at, level = [], 0, 0
    for m in _PART.finditer(text):
        c = m[0]
        if c in "[{":
            level += 1
            if level == most + 1:
                out += [text[at : m.start()], f'"{CUT}"']
        elif c in "]}":
            if level == most + 1:
                at = m.end()
            level -= 1
    return "".join(out) + text[at:]


@F.pandas_udf(StringType())
def _cut_text(texts: pd.Series) -> pd.Series:
    return texts.map(cut_text, na_action="ignore")


def _cut(x: Column, kind: DataType, left: int) -> Column:
    if not isinstance(kind, (StructType, ArrayType, MapType)):
        return x
    if not left:
        return F.when(x.isNotNull(), F.lit(CUT))
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*(_cut(x.getField(f.name), f.dataType, left - 1).alias(f.name) for f in kind.fields)))
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda e: _cut(e, kind.elementType, left - 1))
    return F.transform_values(x, lambda _, e: _cut(e, kind.valueType, left - 1))


def _levels(kind: DataType) -> int:
    inner = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else [kind.valueType] if isinstance(kind, MapType) else None
    return 0 if inner is None else 1 + max(map(_levels, inner), default=0)


def stringify(x: Column, kind: DataType) -> Column:
    """Text of any value: strings as they are, objects as JSON with their nulls, down to KEPT_DEPTH levels.

    A type's own depth is cut in the plan; only variants, whose depth is data, need Python, and only the deep ones.
    """
    if isinstance(kind, StringType):
        return x
    if kind.typeName() == "variant":
        text = F.to_json(x)
        return F.coalesce(_cut_text(F.when(depth(text) > KEPT_DEPTH, text)), text)
    if isinstance(kind, (StructType, ArrayType, MapType)):
        return F.to_json(_cut(x, kind, KEPT_DEPTH) if _levels(kind) > KEPT_DEPTH else x, {"ignoreNullFields": "false"})
    return x.cast("string")
