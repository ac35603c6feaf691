"""JSON records: strict scans, canonical encodings, digests, bundles."""

from __future__ import annotations

import hashlib
import json
import math
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.numeric import ieee_hex, is_finite


class StrictJsonError(ValueError):
    pass


def strict_loads(text: str | bytes, most_depth: int = 100, most_nodes: int = 100_000, most_bytes: int = 64 << 20):
    """JSON in UTF-8 without a byte order mark, duplicate keys, NaN, infinities, overflow or unpaired surrogates, within limits."""
    try:
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
        if len(data) > most_bytes:
            raise StrictJsonError(f"more than {most_bytes} bytes")
        if data.startswith(b"\xef\xbb\xbf"):
            raise StrictJsonError("a byte order mark")
        text = data.decode("utf-8", "surrogatepass" if isinstance(text, str) else "strict")
    except UnicodeDecodeError as e:
        raise StrictJsonError("not UTF-8") from e

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise StrictJsonError("a key is repeated")
        return out

    def bad(name):
        raise StrictJsonError(f"{name} is no JSON number")

    def number(lexeme):
        v = float(lexeme)
        if not math.isfinite(v):
            raise StrictJsonError("a number overflows")
        return v

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=bad, parse_float=number, parse_int=number)
    except (RecursionError, json.JSONDecodeError) as e:
        raise StrictJsonError(str(e)) from e
    count = 0

    def walk(v, depth):
        nonlocal count
        count += 1
        if depth > most_depth or count > most_nodes:
            raise StrictJsonError("too deep or too many values")
        if isinstance(v, str):
            try:
                v.encode()
            except UnicodeEncodeError as e:
                raise StrictJsonError("an unpaired surrogate") from e
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            walk(x, depth + 1)
        for k in v if isinstance(v, dict) else ():
            walk(k, depth + 1)

    walk(value, 1)
    return value


def strict_rows(df: DataFrame, text: str, most_depth: int = 100, most_nodes: int = 100_000, most_bytes: int = 64 << 20) -> DataFrame:
    """df with `fault`: why a row's JSON text isn't strict, null where it is; a null text is a fault of its own. Checked where rows are read."""
    from collections.abc import Iterator

    import pyarrow as pa

    schema = T.StructType([*df.schema.fields, T.StructField("fault", T.StringType())])
    at = df.columns.index(text)

    def fault(value: str | None) -> str | None:
        if value is None:
            return "no text"
        try:
            strict_loads(value, most_depth, most_nodes, most_bytes)
        except StrictJsonError as e:
            return str(e)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fault(v) for v in b.column(at).to_pylist()], pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON file (or many) of the given schema; a malformed record stops the job."""
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")


def strict_column(text: Column) -> Column:
    """Whether a JSON text parses strictly in the JVM: syntax and repeated keys (a VARIANT refuses both)."""
    return F.try_parse_json(text).isNotNull()


def valid(schema: T.StructType, record: str, df: DataFrame, support: list | None = None, output: str | None = None) -> Column:
    """Whether a row's record has all fields that aren't nullable, finite numbers, and an output of the support."""
    checks = []
    for f in schema.fields:
        c = F.col(f"{record}.{f.name}")
        if not f.nullable:
            checks.append(c.isNotNull())
        if isinstance(f.dataType, T.DoubleType):
            checks.append(c.isNull() | is_finite(c))
    if output is not None:
        checks.append(F.coalesce(F.col(output).isin(support), F.lit(False)))
    out = F.lit(True)
    for c in checks:
        out = out & c
    return out


def json_schema(schema: T.StructType) -> dict:
    """The JSON Schema of a struct type: closed objects, required fields."""
    def of(t):
        if isinstance(t, T.StructType):
            return {"type": "object", "additionalProperties": False, "properties": {f.name: of(f.dataType) for f in t.fields}, "required": [f.name for f in t.fields if not f.nullable]}
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": of(t.elementType)}
        return {"type": {T.StringType: "string", T.BooleanType: "boolean"}.get(type(t), "number")}

    return of(schema)


def typed(value: Column, kind: T.DataType) -> Column:
    """A self-describing text of a value for digests of our own: numbers by their bits, so that -0 and 0 differ. The
    canonical encodings of inputs are in `canonical`."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(json.dumps(f.name) + ":"), typed(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name.encode())]
        return F.concat(F.lit('{"object":{'), F.concat_ws(",", *parts), F.lit("}}"))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit('{"array":['), F.array_join(F.transform(value, lambda v: typed(v, kind.elementType)), ","), F.lit("]}"))
    if isinstance(kind, T.BooleanType):
        return F.concat(F.lit('{"boolean":'), value.cast("string"), F.lit("}"))
    if isinstance(kind, T.NumericType):
        return F.concat(F.lit('{"number":"'), ieee_hex(value.cast("double")), F.lit('"}'))
    return F.concat(F.lit('{"string":'), F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2), F.lit("}"))


def typed_digest(value) -> str:
    """The digest of any JSON value on the driver: keys sorted by UTF-8, numbers by their bits."""
    def spell(v) -> str:
        if v is None:
            return '{"null":null}'
        if isinstance(v, bool):
            return '{"boolean":%s}' % str(v).lower()
        if isinstance(v, (int, float)):
            return '{"number":"%s"}' % struct.pack(">d", float(v)).hex()
        if isinstance(v, str):
            return '{"string":%s}' % json.dumps(v, ensure_ascii=False)
        if isinstance(v, list):
            return '{"array":[%s]}' % ",".join(map(spell, v))
        return '{"object":{%s}}' % ",".join(json.dumps(k, ensure_ascii=False) + ":" + spell(v[k]) for k in sorted(v, key=str.encode))

    return hashlib.sha256(spell(value).encode()).hexdigest()


def cache_key(domain: str, request: dict) -> str:
    return hashlib.sha256(domain.encode() + b"\0" + json.dumps(request, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def functions_of(spark: SparkSession, path: str) -> DataFrame:
    """One row per function of a bundle file: id and its record as text."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json(F.get_json_object("value", "$.functions"), "array<string>")).alias("record")).select(F.get_json_object("record", "$.id").alias("id"), "record")


def arguments(text: str) -> list:
    """Call arguments from JSON: an array spreads, anything else is one argument."""
    value = strict_loads(text)
    return value if isinstance(value, list) else [value]
