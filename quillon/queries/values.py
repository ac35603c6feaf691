"""Queries: predicates in full, numbers by their bits and spellings, JSON values, choices."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import numeric as N
from quillon.functions import text as X
from quillon.operators import rules, scoring
from quillon.operators.rules import Node, given
from quillon.queries.cases import table
from quillon.queries.registry import query


def _holds(df, **predicates):
    return df.select(*[c for c in df.columns if c.startswith("id_")], *[rules.column(p, df.schema).alias(k) for k, p in predicates.items()])


@query(
    "SELECT l_orderkey AS id_order, l_linenumber AS id_line, pow(l_quantity, 2) % 7 > 3 AS power_rest, -l_quantity < -25 AS negated, l_quantity + l_discount - l_tax > 25.5 AS sums, l_extendedprice * (1 - l_discount) > 30000 AS product, "
    "l_extendedprice / l_quantity <= 1500 AS ratio, l_returnflag <> 'R' AS differs, l_quantity <> 17 AS other FROM lineitem"
)
def predicate_arithmetic(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "id_order", "l_linenumber": "id_line"})
    q, price, less, tax = (given(n) for n in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return _holds(
        df, power_rest=q**2 % 7 > 3, negated=-q < Node("unary", "-", (rules.node(25),)), sums=q + less - tax > 25.5, product=price * (rules.node(1) - less) > 30000,
        ratio=price / q <= 1500, differs=given("l_returnflag").ne("R"), other=q.ne(17),
    )


@query(
    "SELECT c_custkey AS id_key, len(c_mktsegment) > 8 AS long_name, c_mktsegment[1] = 'B' AS first_unit, c_mktsegment[3] >= 'I' AS third_unit, len(c_mktsegment) < 30 AS no_unit, true AS absent, len(string_split(c_name, '#')) = 2 AS parts, "
    "string_split(c_name, '#')[1] = 'Customer' AS first_part, true AS no_part, NOT (c_acctbal > 0) AND (c_nationkey < 5 OR c_mktsegment = 'BUILDING') AS joined FROM customer"
)
def predicate_access(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    df = c.select(F.col("c_custkey").alias("id_key"), F.struct(F.col("c_mktsegment").alias("segment"), F.split("c_name", "#").alias("parts")).alias("who"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    who = given("who")
    segment, parts = who.segment, Node("property", "parts", (who,))
    return _holds(
        df, long_name=segment.length > 8, first_unit=segment[0].eq("B"), third_unit=segment[2] >= "I", no_unit=segment[30].eq(who.nothing), absent=who.nothing.eq(who.missing),
        parts=parts.length.eq(2), first_part=parts[0].eq("Customer"), no_part=parts[2].eq(who.nothing), joined=~(given("balance") > 0) & ((given("nation") < 5) | segment.eq("BUILDING")),
    )


_SPECS = {
    "fine": ([("always", given("a") > 1, "x")], None),
    "output outside": ([("always", given("a") > 1, "z")], "error"),
    "constant": ([("always", rules.node(1) < 2, "x")], "error"),
    "contradiction": ([("always", given("a") > 1, "x"), ("always", given("a") > 1, "y")], "error"),
    "required and forbidden": ([("always", given("a") > 1, "x"), ("never", given("a") > 1, "x")], "error"),
    "same twice": ([("always", given("a") > 1, "x"), ("always", given("a") > 1, "x")], None),
    "too deep": ([("always", rules.Node("unary", "!", (given("b"),)), "x")], None),
    "missing input": ([("always", given("nowhere") > 1, "x")], "error"),
    "text against number": ([("always", given("t") > 1, "x")], "error"),
    "text is no condition": ([("always", given("t"), "x")], "error"),
    "not of a number": ([("always", ~given("a"), "x")], "error"),
}


def _verdict(spec) -> str:
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("t", T.StringType())])
    made = [rules.Rule(*s) for s in spec]
    try:
        rules.check(made, ["x", "y"])
        for r in made:
            rules.column(r.predicate, schema)
    except rules.RuleError:
        return "error"
    return "ok"


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v[1] or 'ok'}')" for k, v in _SPECS.items()) + ") AS t(spec, verdict)")
def rule_checks(spark, sf_dir):
    return spark.createDataFrame([(k, _verdict(v[0])) for k, v in _SPECS.items()], "spec string, verdict string")


_BITS = "CASE p_size " + " ".join(f"WHEN {i} THEN '{struct.pack('>d', float(i)).hex()}'" for i in range(1, 51)) + " END"


@query(f"SELECT p_partkey, {_BITS} AS bits, p_size = 7 AS seven, CAST(least(greatest(p_retailprice, 950), 1200) AS DOUBLE) AS held, p_retailprice AS exact, [0, p_size]::DOUBLE[] AS pair FROM part")
def number_identity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    big = F.lit(1e17)
    return p.select(
        "p_partkey", N.ieee_hex(size).alias("bits"), N.same_bits(size, F.lit(7.0)).alias("seven"), N.clamp(F.col("p_retailprice"), 950.0, 1200.0).alias("held"),
        N.compensated_sum(F.array(big, F.col("p_retailprice"), -big)).alias("exact"), N.expanded(F.array(size)).alias("pair"),
    )


_PRICE = "printf('%.2f', c_acctbal)"


@query(
    f"WITH t AS (SELECT c_custkey, {_PRICE} AS t FROM customer) SELECT c_custkey, len(regexp_extract(t, '\\.([0-9]*?)0*$', 1)) AS places, pow(10, -len(regexp_extract(t, '\\.([0-9]*?)0*$', 1))) AS step, NOT regexp_matches(t, '\\.[0-9]*0$') AS canonical, "
    "CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey * 60 WHEN 2 THEN c_custkey * 86400 END AS seconds, CASE WHEN c_custkey < 1024 THEN c_custkey || ' B' ELSE printf('%.1f KiB', round(c_custkey / 1024.0, 1)) END AS size FROM t"
)
def decimal_spelling(spark, sf_dir):
    k = F.col("c_custkey")
    t = F.format_string("%.2f", "c_acctbal")
    duration = F.concat(k.cast("string"), F.element_at(F.array(*[F.lit(u) for u in ("s", "m", "d", "y")]), (k % 4 + 1).cast("int")))
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", N.decimal_places(t).cast("long").alias("places"), N.one_step(t).alias("step"), N.canonical_decimal(t).alias("canonical"), N.duration_seconds(duration).alias("seconds"), X.bytes_text(k).alias("size"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 3 = 0 THEN 'T10:00:00Z' WHEN o_orderkey % 3 = 1 THEN 'T12:00:00+02:00' ELSE '' END AS text, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate + INTERVAL 10 HOUR END AS at FROM orders")
def timestamps(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k == 0, "T10:00:00Z").when(k == 1, "T12:00:00+02:00").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), X.rfc3339(text).cast("timestamp_ntz").alias("at"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, true AS same, false AS other, '{\"k\":' || json_extract_string(props, '$.k') || ',\"n\":1}' AS filled FROM events")
def json_values(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    record = F.from_json("props", "struct<k: bigint>")
    filled = X.field_set(record, "/n", F.lit(1))
    spelled = F.concat(F.lit('{ "k" : '), X.json_get(F.col("props"), "/k"), F.lit(" }"))
    return e.select("event_id", X.json_get(F.col("props"), "/k").alias("k"), X.json_equal(F.col("props"), spelled).alias("same"), X.json_equal(F.col("props"), F.to_json(filled)).alias("other"), F.to_json(filled).alias("filled"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'override' WHEN p_size < 30 THEN 'recorded' ELSE 'default' END AS source, CASE WHEN p_size < 10 THEN CAST(p_size AS DOUBLE) WHEN p_size < 30 THEN p_retailprice ELSE 2.5 END AS value FROM part")
def price_choice(spark, sf_dir):
    size = F.col("p_size")
    got = X.first_available(("override", F.when(size < 10, size)), ("recorded", F.when(size < 30, F.col("p_retailprice"))), ("default", F.lit(2.5)))
    return table(spark, sf_dir, "part").select("p_partkey", got["source"].alias("source"), got["value"].alias("value"))


@query("SELECT l_orderkey AS k, CASE l_returnflag WHEN 'R' THEN 'yes' ELSE 'no' END AS label, l_returnflag = 'R' AS answer, CAST(sum(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY ALL")
def stored_labels(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    g = l.groupBy(F.col("l_orderkey").alias("k"), F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("label")).agg(F.sum("l_quantity").cast("long").cast("string").alias("s"))
    return g.select("k", X.label_of(F.col("label"), "choice").alias("label"), X.label_of(F.col("label"), "boolean").alias("answer"), X.label_of(F.col("s"), "score").cast("long").alias("score"))


@query("SELECT o_orderkey, o_totalprice > 150000 AS large, CASE WHEN o_totalprice > 150000 THEN 'senior' ELSE 'junior' END AS desk, CASE WHEN o_totalprice > 150000 AND o_orderpriority = '1-URGENT' THEN 'now' ELSE 'later' END AS turn FROM orders")
def staged_plan(spark, sf_dir):
    stages = [
        {"large": lambda d: d["o_totalprice"] > 150000},
        {"desk": lambda d: F.when(d["large"], "senior").otherwise("junior")},
        {"turn": lambda d: F.when((d["desk"] == "senior") & (d["o_orderpriority"] == "1-URGENT"), "now").otherwise("later")},
    ]
    return scoring.in_stages(table(spark, sf_dir, "orders"), stages).select("o_orderkey", "large", "desk", "turn")


_TEXT = "CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '[' || props || ',1e3,null]' WHEN 2 THEN '{\"a\":1,\"a\":2}' WHEN 3 THEN '[NaN]' WHEN 4 THEN repeat('[', 40) || repeat(']', 40) ELSE chr(65279) || '1' END"


@query("SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'a key is repeated' WHEN 3 THEN 'NaN is no JSON number' WHEN 4 THEN 'too deep or too many values' WHEN 5 THEN 'a byte order mark' END AS fault FROM events")
def strict_scan(spark, sf_dir):
    from quillon.sources import json_records

    e = table(spark, sf_dir, "events").select("event_id", F.expr(_TEXT.replace("chr(65279)", "'\ufeff'")).alias("body"))
    return json_records.strict_rows(e, "body", most_depth=20).select("event_id", "fault")


_CALLS = "c AS (SELECT p_partkey AS call, 'f' || p_size % 5 AS function, p_type AS input FROM part), f AS (SELECT * FROM (VALUES ('f0', 'e0', NULL), ('f1', 'e0', 'a1'), ('f2', 'e0', 'a1'), ('f3', 'e1', 'a2'), ('f4', 'e1', NULL)) AS t(function, encoder, adapter))"


def _stage(spark, sf_dir):
    calls = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("call"), F.concat(F.lit("f"), (F.col("p_size") % 5).cast("string")).alias("function"), F.col("p_type").alias("input"))
    functions = spark.createDataFrame([("f0", "e0", None), ("f1", "e0", "a1"), ("f2", "e0", "a1"), ("f3", "e1", "a2"), ("f4", "e1", None)], "function string, encoder string, adapter string")
    encode = lambda d: d.withColumn("encoded", F.length("input") + F.when(F.col("encoder") == "e0", 1).otherwise(2))
    adapt = lambda d: d.withColumn("adapted", F.col("encoded") * F.when(F.col("adapter") == "a1", 10).otherwise(100))
    head = lambda d: d.withColumn("output", F.col("adapted") + F.substring("function", 2, 1).cast("int"))
    return scoring.fused_stage(calls, functions, encode, adapt, head)


@query(f"WITH {_CALLS} SELECT call, function, CAST((len(input) + CASE encoder WHEN 'e0' THEN 1 ELSE 2 END) * CASE WHEN adapter IS NULL THEN 1 WHEN adapter = 'a1' THEN 10 ELSE 100 END + CAST(function[2] AS INTEGER) AS INTEGER) AS output FROM c JOIN f USING (function)")
def shared_passes(spark, sf_dir):
    return _stage(spark, sf_dir)[0]


@query(f"WITH {_CALLS} SELECT count(DISTINCT (encoder, input)) AS encodings, count(DISTINCT (encoder, adapter, input)) FILTER (WHERE adapter IS NOT NULL) AS adaptations, count(*) AS heads FROM c JOIN f USING (function)")
def pass_counts(spark, sf_dir):
    return _stage(spark, sf_dir)[1]
