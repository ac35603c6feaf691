"""Text functions: UTF-16 units, canonical spellings, word sets, JSON paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16(text: Column) -> Column:
    return F.encode(text, "UTF-16BE")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(utf16(text)) / 2).cast("long")


def utf16_unit(text: Column, index: Column) -> Column:
    """The unit at an index as four hex digits; null beyond the end."""
    unit = F.substring(utf16(text), index * 2 + 1, F.lit(2))
    return F.when((index >= 0) & (index < utf16_length(text)), F.lower(F.hex(unit)))


def utf16_less(a: Column, b: Column) -> Column:
    return utf16(a) < utf16(b)


def signed(x: Column) -> Column:
    """Whether a number, a zero too, has a sign."""
    return x.cast("string").startswith("-")


def ecma_number(x: Column, signed_zero: bool = False) -> Column:
    """ECMAScript's spelling of a finite double: integers plainly below 1e21, a point and
    the shortest digits from 1e-6 on, an exponent beyond; both zeros are 0, or -0 keeps its sign."""
    text = x.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)", 1), r"\.0$", "")
    exponent = F.when(text.contains("E"), F.regexp_extract(text, r"E(-?[0-9]+)$", 1)).otherwise("0").cast("int")
    digits = F.regexp_replace(mantissa, r"\.", "")
    # the point stands after `point` digits
    point = F.when(mantissa.contains("."), F.instr(mantissa, ".") - 1).otherwise(F.length(mantissa)) + exponent
    lead = F.length(F.regexp_extract(digits, r"^(0*)", 1))
    bare = F.regexp_replace(F.regexp_replace(digits, r"^0+", ""), r"0+$", "")
    # Java gives two digits where one would do; they differ for the least doubles only, as 4.9E-324
    one = F.round(F.when(F.length(bare) == 2, bare).cast("int") / 10).cast("int")
    short = F.concat(one.cast("string"), F.lit("E"), (point - lead - 1).cast("string")).cast("double") == F.abs(x)
    short = (F.abs(x) < 1e-300) & F.coalesce(short, F.lit(False))
    at = point - lead + F.when(short & (one == 10), 1).otherwise(0)
    bare = F.when(short, F.regexp_replace(one.cast("string"), "0$", "")).otherwise(bare)
    n = F.length(bare)
    plain = (
        F.when((at >= n) & (at <= 21), F.rpad(bare, at, "0"))
        .when((at > 0) & (at < n), F.concat(F.substring(bare, F.lit(1), at), F.lit("."), F.substring(bare, at + 1, n)))
        .when((at > -6) & (at <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), bare))
        .otherwise(
            F.concat(
                F.substring(bare, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(bare, F.lit(2), n))).otherwise(""),
                F.lit("e"), F.when(at > 0, "+").otherwise("-"), F.abs(at - 1).cast("string"),
            )
        )
    )
    zero = F.when(signed(x), "-0").otherwise("0") if signed_zero else F.lit("0")
    return F.when(x == 0, zero).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), plain))


#: What a text may consist of to stand bare in the compact encoding; fixed value.
BARE = r"^[A-Za-z_][A-Za-z0-9_.-]*$"


def quoted(text: Column) -> Column:
    """A JSON string with the short escapes and \\u00xx for other control characters."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for plain, escape in (("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escape))
    rest = out
    for code in (c for c in range(32) if chr(c) not in "\b\f\n\r\t"):
        rest = F.replace(rest, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    out = F.when(out.rlike(r"[\x00-\x1f]"), rest).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def compact_text(text: Column) -> Column:
    """A text as a bare token where it can't be taken for anything else, quoted otherwise."""
    return F.when(text.rlike(BARE) & ~text.isin("true", "false", "null"), text).otherwise(quoted(text))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a or b| of two arrays of distinct values; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def pointer_token(text: Column) -> Column:
    """A JSON Pointer's escaping of one step."""
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def leaves(record: Column, schema, path: str = "") -> list[tuple[str, Column]]:
    """(path, value as text) of every leaf of a struct of known schema."""
    from pyspark.sql import types as T

    if isinstance(schema, T.StructType):
        out = []
        for f in schema.fields:
            step = f.name.replace("~", "~0").replace("/", "~1")
            out += leaves(record[f.name], f.dataType, f"{path}/{step}")
        return out
    return [(path, record.cast("string"))]


def leaf_map(record: Column, schema) -> Column:
    return F.map_from_entries(F.array(*[F.struct(F.lit(p).alias("key"), v.alias("value")) for p, v in leaves(record, schema)]))


def changed_paths(left: Column, right: Column) -> Column:
    """Sorted paths at which two leaf maps differ."""
    keys = F.array_sort(F.array_union(F.map_keys(left), F.map_keys(right)))
    return F.filter(keys, lambda k: ~F.element_at(left, k).eqNullSafe(F.element_at(right, k)))


def label_of(text: Column, kind: str) -> Column:
    """A stored label by its kind: choice (text), yes/no (boolean), score (number)."""
    return {"choice": text, "boolean": F.lower(text).isin("yes", "true"), "score": text.cast("int")}[kind]


def probabilities_of(json_map: Column, support: list[str]) -> Column:
    """A JSON map value -> probability as an array in support order; missing values are 0."""
    m = F.from_json(json_map, "map<string,double>")
    return F.array(*[F.coalesce(m[v], F.lit(0.0)) for v in support])


def fixed4(x: Column) -> Column:
    return F.format_string("%.4f", x)


def short_id(text: Column, length: int = 12) -> Column:
    return F.substring(text, 1, length)


def rfc3339(text: Column) -> Column:
    """The timestamp of an RFC 3339 text with a zone; null where it isn't one."""
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$")
    return F.when(shape, F.try_to_timestamp(text))


def bytes_text(n: Column) -> Column:
    """1.5 KiB and the like."""
    def unit(power: int, name: str) -> Column:
        return F.concat(F.format_string("%.1f", n / F.lit(float(1024**power))), F.lit(f" {name}"))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1, "KiB")).when(n < 1024**3, unit(2, "MiB")).otherwise(unit(3, "GiB"))


def path_steps(path: str) -> list[str]:
    """The steps of a JSON Pointer."""
    return [s.replace("~1", "/").replace("~0", "~") for s in path.split("/")[1:]]


def json_get(value: Column, path: str) -> Column:
    """The text at a JSON Pointer of a JSON text; null where there is nothing."""
    steps = "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in path_steps(path))
    return F.try_variant_get(F.try_parse_json(value), F.lit("$" + steps), "string")


def field_set(record: Column, path: str, new: Column) -> Column:
    """A struct with the field at a JSON Pointer replaced (or added at the last step)."""
    step, *rest = path_steps(path)
    inner = field_set(record[step], "/" + "/".join(s.replace("~", "~0").replace("/", "~1") for s in rest), new) if rest else new
    return record.withField(f"`{step}`", inner)


def json_equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts hold the same value: key order and spelling of numbers don't count, kinds do. A text that is no JSON equals none."""
    x, y = (F.to_json(F.try_parse_json(c)) for c in (a, b))
    return F.coalesce(x == y, F.lit(False))


def first_available(*choices: tuple[str, Column]) -> Column:
    """(source, value) of the first choice that isn't null."""
    out = F.struct(F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("value"))
    for name, value in reversed(choices):
        out = F.when(value.isNotNull(), F.struct(F.lit(name).alias("source"), value.cast("double").alias("value"))).otherwise(out)
    return out
