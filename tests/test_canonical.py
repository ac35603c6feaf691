"""The canonical encodings against the published vectors, byte for byte."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import text as X
from quillon.sources import canonical as C

D, S, B = T.DoubleType(), T.StringType(), T.BooleanType()


def struct(*fields):
    return T.StructType([T.StructField(n, t, True, m[0] if m else None) for n, t, *m in fields])


#: Records, their compact texts and digests.
CUSTOMER = struct(("customer", struct(("priorRefunds", D), ("tier", S))), ("order", struct(("ageDays", D), ("status", S), ("total", D))))
NUMBERS = {
    "integer": 42.0, "negative": -7.0, "fraction": 3.25, "tiny": 1e-7, "huge": 1e21, "bigDecimal": 123456789012345680000.0, "zero": -0.0, "tenth": 0.1, "smallExponent": 1.5e-7,
    "max": 1.7976931348623157e308, "min": 5e-324, "boundaryLow": 1e-6, "boundaryHigh": 1e20,
}
STRINGS = {
    "bare": "standard", "digits": "12", "reserved": "true", "spaced": "a b", "escaped": 'a\n"é', "empty": "", "comma": "with,comma", "equals": "x=y", "dotted": "_under.score-1", "braced": "{brace}",
    "unicode": "café", "quoteInside": 'say "hi"', "nullWord": "null",
}
VECTORS = [
    (CUSTOMER, ((0.0, "standard"), (12.0, "paid", 88.5)), "customer={priorRefunds=0,tier=standard} order={ageDays=12,status=paid,total=88.5}", "c5295cbd11bd99eb494005bd9dd229ec0c079e4547b3c5cca8c33b843adb6d61"),
    (CUSTOMER, ((18.0, "enterprise"), (120.0, "fraudulent", 12345.67)), "customer={priorRefunds=18,tier=enterprise} order={ageDays=120,status=fraudulent,total=12345.67}", "6830c3363799e1338ea8bb7a28b439e0c27383da9c7166d6e9ec4e3de0bbbf31"),
    (
        struct(("n", struct(*[(k, D) for k in NUMBERS]))), (tuple(NUMBERS.values()),),
        "n={bigDecimal=123456789012345680000,boundaryHigh=100000000000000000000,boundaryLow=0.000001,fraction=3.25,huge=1e+21,integer=42,max=1.7976931348623157e+308,min=5e-324,negative=-7,smallExponent=1.5e-7,tenth=0.1,tiny=1e-7,zero=-0}",
        "6bb0590b568578119b1715c24f6148f5abfb9a9c27cf83fe3d43af69f097c699",
    ),
    (
        struct(("s", struct(*[(k, S) for k in STRINGS]))), (tuple(STRINGS.values()),),
        's={bare=standard,braced="{brace}",comma="with,comma",digits="12",dotted=_under.score-1,empty="",equals="x=y",escaped="a\\n\\"é",nullWord="null",quoteInside="say \\"hi\\"",reserved="true",spaced="a b",unicode="café"}',
        "80ec41727e7d4a2c99eebbf63a578315fa49b0cff95a6751276f44161a4282bc",
    ),
    (
        struct(("first", B), ("second", struct(("items", T.ArrayType(struct(("id", D), ("tags", T.ArrayType(S))))), ("pair", struct(("_1", S), ("_2", D)), {"tuple": True}), ("empty", T.ArrayType(D)), ("inner", struct(("z", B), ("a", S), ("m", S, {"optional": True}))), ("maybe", S, {"optional": True})))),
        (False, ([(1.0, ["x", "y z"]), (2.0, [])], ("k", -1.5), [], (True, None, None), None)),
        "first=false second={empty=[],inner={a=null,z=true},items=[{id=1,tags=[x,\"y z\"]},{id=2,tags=[]}],pair=[k,-1.5]}", "f52306d64dcc7b9823ddf4dc6627b9414ddc0ac46890fd35284c3df31a3160a2",
    ),
    (
        struct(("k", struct(("plain", D), ("with space", D), ("12", D), ("true", D), ("ünïcode", D)))), ((1.0, 2.0, 3.0, 4.0, 5.0),),
        'k={"12"=3,plain=1,"true"=4,"with space"=2,"ünïcode"=5}', "76ef3c4688e982013b7c1b118e3d5889f986cc3b75e6740f76a02879df691b53",
    ),
]


@pytest.mark.parametrize("vector", VECTORS, ids=lambda v: v[2][:20])
def test_compact_vectors(spark, vector):
    kind, row, text, digest = vector
    df = spark.createDataFrame([(row,)], T.StructType([T.StructField("r", kind)]))
    assert tuple(df.select(C.compact_inputs(F.col("r"), kind), C.input_digest(F.col("r"), kind)).first()) == (text, digest)


def test_compact_unions_literals_and_enums(spark):
    kind = struct(("tier", S), ("mixedNumber", T.VariantType()), ("mixedString", T.VariantType()), ("colour", S), ("level", D), ("flag", B), ("nothing", T.NullType()))
    df = spark.range(1).select(F.struct(F.lit("standard").alias("tier"), F.parse_json(F.lit("12")).alias("mixedNumber"), F.parse_json(F.lit('"12"')).alias("mixedString"), F.lit("green").alias("colour"), F.lit(2.5).alias("level"), F.lit(True).alias("flag"), F.lit(None).alias("nothing")).alias("r"))
    got = df.select(C.compact_inputs(F.col("r"), kind), C.input_digest(F.col("r"), kind)).first()
    assert tuple(got) == ('tier=standard mixedNumber=12 mixedString="12" colour=green level=2.5 flag=true nothing=null', "2361246830dcf3f8cb96d3eb04fe4fd29d144c41c3629f298b34ab590c0a1e8d")


def test_exact_envelope(spark):
    kind = struct(("obj", struct(("a", D), ("b", D), ("text", S), ("zero", D))))
    df = spark.createDataFrame([(((1.0, 2.0, 'a\n"é', -0.0),),)], T.StructType([T.StructField("r", kind)]))
    want = '["tag",1,[["obj",["object",[["a",["number","3ff0000000000000"]],["b",["number","4000000000000000"]],["text",["string","a\\n\\"é"]],["zero",["number","8000000000000000"]]]]]]]'
    assert df.select(C.exact_inputs(F.col("r"), kind, "tag")).first()[0] == want
    kind = struct(("u", S, {"union": ["enterprise", "standard"]}), ("e", D, {"enum": {"name": "Level", "values": [1.0, 2.5, 10.0]}}), ("l", B, {"literal": True}), ("t", struct(("_1", S), ("_2", D)), {"tuple": True}), ("o", S))
    df = spark.createDataFrame([(("standard", 2.5, True, ("k", -0.0), None),)], T.StructType([T.StructField("r", kind)]))
    want = '["tag",1,[["u",["union",1,["literal",["string","standard"]]]],["e",["enum","Level",1,["number","4004000000000000"]]],["l",["literal",["boolean",true]]],["t",["tuple",[["string","k"],["number","8000000000000000"]]]],["o",["null"]]]]'
    assert df.select(C.exact_inputs(F.col("r"), kind, "tag")).first()[0] == want


def test_least_doubles_and_control_characters(spark):
    for x, text in ((5e-324, "5e-324"), (1e-323, "1e-323"), (1.5e-323, "1.5e-323"), (2e-323, "2e-323"), (-5e-324, "-5e-324"), (2.2250738585072014e-308, "2.2250738585072014e-308")):
        assert spark.range(1).select(X.ecma_number(F.lit(x))).first()[0] == text
    assert spark.range(1).select(X.quoted(F.lit("\x01\x1f\x7f"))).first()[0] == '"\\u0001\\u001f\x7f"'
    assert spark.range(1).select(X.compact_text(F.lit("a:b"))).first()[0] == '"a:b"'
