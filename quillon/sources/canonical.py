"""The two canonical encodings of a call's inputs, byte for byte: compact text (v2) and the exact typed envelope (v1).

A record is a struct whose fields are the inputs, in order; values follow its types: structs are objects (their fields in
byte order of their names), arrays arrays, a null is `null`. Field metadata says what Spark's types can't: `optional` (a null
is an absent field), `tuple` (a struct by position), `literal` (one fixed value), `enum` (a dict of name and values), `union`
(a list of literal values, or of kinds of a VARIANT: null, boolean, number, string).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.numeric import ieee_hex
from quillon.functions.text import BARE, compact_text, ecma_number, quoted

RESERVED = ("true", "false", "null")


def name_text(name: str) -> str:
    """A field's name as the compact text spells it."""
    return name if re.fullmatch(BARE.strip("^$"), name) and name not in RESERVED else json.dumps(name, ensure_ascii=False)


def _ordered(kind: T.StructType) -> list[T.StructField]:
    return sorted(kind.fields, key=lambda f: f.name.encode())


def _present(value: Column, field: T.StructField, text: Column) -> Column:
    """The text of a field; null, so that it is left out, where an optional one is absent."""
    return F.when(value.isNotNull(), text) if field.metadata.get("optional") else text


def compact_value(value: Column, kind: T.DataType, meta: dict | None = None) -> Column:
    if isinstance(kind, T.NullType):
        return F.lit("null")
    if isinstance(kind, T.StructType):
        if (meta or {}).get("tuple"):
            parts = [compact_value(value[f.name], f.dataType, f.metadata) for f in kind.fields]
            text = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
        else:
            pairs = [_present(value[f.name], f, F.concat(F.lit(name_text(f.name) + "="), compact_value(value[f.name], f.dataType, f.metadata))) for f in _ordered(kind)]
            text = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: compact_value(v, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.BooleanType):
        text = value.cast("string")
    elif isinstance(kind, T.NumericType):
        text = ecma_number(value.cast("double"), signed_zero=True)
    elif isinstance(kind, T.VariantType):
        is_text = F.schema_of_variant(value) == "STRING"
        is_flag = F.schema_of_variant(value) == "BOOLEAN"
        number = ecma_number(F.try_variant_get(value, "$", "double"), signed_zero=True)
        text = F.when(F.is_variant_null(value), "null").when(is_text, compact_text(F.try_variant_get(value, "$", "string"))).when(is_flag, F.try_variant_get(value, "$", "string")).otherwise(number)
    else:
        text = compact_text(value)
    return F.coalesce(text, F.lit("null"))


def compact_inputs(record: Column, kind: T.StructType) -> Column:
    """The compact text of a record of inputs: name=value pairs in the inputs' order, one blank apart."""
    return F.concat_ws(" ", *[F.concat(F.lit(name_text(f.name) + "="), compact_value(record[f.name], f.dataType, f.metadata)) for f in kind.fields])


def input_digest(record: Column, kind: T.StructType) -> Column:
    return F.sha2(compact_inputs(record, kind), 256)


def _primitive(value: Column, kind: T.DataType) -> Column:
    """An array of a tag and, but for null, the value."""
    if isinstance(kind, T.NullType):
        return F.lit('["null"]')
    if isinstance(kind, T.BooleanType):
        text = F.concat(F.lit('["boolean",'), value.cast("string"), F.lit("]"))
    elif isinstance(kind, T.NumericType):
        text = F.concat(F.lit('["number","'), ieee_hex(value.cast("double")), F.lit('"]'))
    elif isinstance(kind, T.VariantType):
        what = F.schema_of_variant(value)
        get = lambda t: F.try_variant_get(value, "$", t)
        text = F.when(F.is_variant_null(value), F.lit('["null"]')).when(what == "STRING", _primitive(get("string"), T.StringType())).when(what == "BOOLEAN", _primitive(get("boolean"), T.BooleanType()))
        text = text.otherwise(_primitive(get("double"), T.DoubleType()))
    else:
        text = F.concat(F.lit('["string",'), quoted(value), F.lit("]"))
    return F.coalesce(text, F.lit('["null"]'))


def _same(value: Column, kind: T.DataType, wanted) -> Column:
    """Whether a value is a literal, numbers by their bits."""
    if wanted is None:
        return value.isNull()
    if isinstance(kind, T.NumericType):
        return F.lit(not isinstance(wanted, str)) & (ieee_hex(value.cast("double")) == ieee_hex(F.lit(float(wanted if not isinstance(wanted, str) else 0))))
    return value == F.lit(wanted)


def exact_value(value: Column, kind: T.DataType, meta: dict | None = None) -> Column:
    meta = meta or {}
    if "literal" in meta:
        return F.concat(F.lit('["literal",'), _primitive(value, kind), F.lit("]"))
    if "enum" in meta:
        index = F.coalesce(*[F.when(_same(value, kind, v), F.lit(str(i))) for i, v in enumerate(meta["enum"]["values"])])
        return F.concat(F.lit(f'["enum",{json.dumps(meta["enum"]["name"], ensure_ascii=False)},'), index, F.lit(","), _primitive(value, kind), F.lit("]"))
    if "union" in meta and isinstance(kind, T.VariantType):
        what = F.when(F.is_variant_null(value), "null").when(F.schema_of_variant(value) == "STRING", "string").when(F.schema_of_variant(value) == "BOOLEAN", "boolean").otherwise("number")
        index = F.coalesce(*[F.when(what == v, F.lit(str(i))) for i, v in enumerate(meta["union"])])
        return F.concat(F.lit('["union",'), index, F.lit(","), _primitive(value, kind), F.lit("]"))
    if "union" in meta:
        index = F.coalesce(*[F.when(_same(value, kind, v), F.lit(str(i))) for i, v in enumerate(meta["union"])])
        return F.concat(F.lit('["union",'), index, F.lit(',["literal",'), _primitive(value, kind), F.lit("]]"))
    if isinstance(kind, T.StructType):
        if meta.get("tuple"):
            text = F.concat(F.lit('["tuple",['), F.concat_ws(",", *[exact_value(value[f.name], f.dataType, f.metadata) for f in kind.fields]), F.lit("]]"))
        else:
            pairs = [_present(value[f.name], f, F.concat(F.lit(f"[{json.dumps(f.name, ensure_ascii=False)},"), exact_value(value[f.name], f.dataType, f.metadata), F.lit("]"))) for f in _ordered(kind)]
            text = F.concat(F.lit('["object",['), F.concat_ws(",", *pairs), F.lit("]]"))
        return F.when(value.isNotNull(), text).otherwise('["null"]')
    if isinstance(kind, T.ArrayType):
        items = F.array_join(F.transform(value, lambda v: exact_value(v, kind.elementType)), ",")
        return F.when(value.isNotNull(), F.concat(F.lit('["array",['), items, F.lit("]]"))).otherwise('["null"]')
    return _primitive(value, kind)


def exact_inputs(record: Column, kind: T.StructType, tag: str) -> Column:
    """The exact envelope of a record of inputs: the encoding's tag, version 1, and [name, typed value] in the inputs' order."""
    pairs = [F.concat(F.lit(f"[{json.dumps(f.name, ensure_ascii=False)},"), exact_value(record[f.name], f.dataType, f.metadata), F.lit("]")) for f in kind.fields]
    return F.concat(F.lit(f"[{json.dumps(tag)},1,["), F.concat_ws(",", *pairs), F.lit("]]"))
