"""Queries: canonical encodings, JSON, text, numbers, generators, streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import numeric as N
from quillon.functions import text as X
from quillon.operators import datasets, generate, rules
from quillon.operators.generate import Field
from quillon.queries.cases import CASES, SCORED, SUPPORT, policy, ruled, scored, table
from quillon.queries.registry import query
from quillon.sources import canonical, json_records
from quillon.streaming import events as streams

_RECORD = T.StructType([T.StructField("size", T.DoubleType(), False), T.StructField("brand", T.StringType(), False), T.StructField("kind", T.StringType(), False), T.StructField("large", T.BooleanType(), False)])


def _record(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    r = F.struct(F.col("p_size").cast("double").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), (F.col("p_size") > 25).alias("large"))
    return p.select("p_partkey", r.alias("r"))


_BARE = "CASE WHEN regexp_full_match({c}, '[A-Za-z_][A-Za-z0-9_.-]*') THEN {c} ELSE '\"' || {c} || '\"' END"
_COMPACT = "'size=' || p_size || ' brand=' || " + _BARE.format(c="p_brand") + " || ' kind=' || " + _BARE.format(c="p_type") + " || ' large=' || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END"


@query(f"SELECT p_partkey, {_COMPACT} AS text FROM part")
def canonical_compact(spark, sf_dir):
    return _record(spark, sf_dir).select("p_partkey", canonical.compact_inputs(F.col("r"), _RECORD).alias("text"))


@query(f"SELECT p_partkey, sha256({_COMPACT}) AS digest FROM part")
def input_digest(spark, sf_dir):
    return _record(spark, sf_dir).select("p_partkey", canonical.input_digest(F.col("r"), _RECORD).alias("digest"))


@query("SELECT o_orderkey, CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS whole, CASE WHEN round(o_totalprice * 100) % 100 = 0 THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END AS price FROM orders")
def number_spelling(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", X.ecma_number(F.round("o_totalprice")).alias("whole"), X.ecma_number(F.col("o_totalprice")).alias("price"))


@query("SELECT event_id, '/props/k' AS path, json_extract_string(props, '$.k') AS leaf FROM events")
def json_leaves(spark, sf_dir):
    schema = T.StructType([T.StructField("props", T.StructType([T.StructField("k", T.LongType())]))])
    e = table(spark, sf_dir, "events").select("event_id", F.struct(F.from_json("props", schema["props"].dataType).alias("props")).alias("r"))
    return e.select("event_id", F.explode(X.leaf_map(F.col("r"), schema)).alias("path", "leaf"))


@query("WITH p AS (SELECT a.p_partkey AS k, concat_ws(',', CASE WHEN a.p_brand <> b.p_brand THEN '/brand' END, CASE WHEN a.p_size <> b.p_size THEN '/size' END, CASE WHEN a.p_type <> b.p_type THEN '/type' END) AS paths FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT k, paths, len(paths) > 0 AND NOT contains(paths, ',') AS one FROM p")
def json_diff_paths(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    schema = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("brand", T.StringType()), T.StructField("type", T.StringType())])
    r = F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    m = p.select("p_partkey", X.leaf_map(r, schema).alias("m"))
    j = m.alias("a").join(m.alias("b"), F.col("b.p_partkey") == F.col("a.p_partkey") + 1)
    paths = X.changed_paths(F.col("a.m"), F.col("b.m"))
    return j.select(F.col("a.p_partkey").alias("k"), F.array_join(paths, ",").alias("paths"), (F.size(paths) == 1).alias("one"))


_WORDS = "list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'))"


@query("WITH w AS (SELECT a.doc_id, " + _WORDS.format(c="a.text") + " AS x, " + _WORDS.format(c="b.text") + " AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT doc_id, round(1 - len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS distance FROM w")
def jaccard_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    j = d.alias("a").join(d.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1)
    return j.select(F.col("a.doc_id").alias("doc_id"), F.round(X.jaccard_distance(X.word_set(F.col("a.text")), X.word_set(F.col("b.text"))), 6).alias("distance"))


@query("SELECT lang, CAST(sum(len(text)) AS BIGINT) AS units, count(*) FILTER (WHERE text LIKE '%~%' OR text LIKE '%/%') AS escaped FROM documents GROUP BY lang")
def utf16_length(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(X.utf16_length(t)).alias("units"), F.count_if(X.pointer_token(t) != t).alias("escaped"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, true AS strict FROM events")
def strict_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), json_records.strict_column(F.col("props")).alias("strict"))


@query("SELECT p_partkey, (p_brand IS NOT NULL AND p_size BETWEEN 1 AND 50) AS valid FROM part")
def row_validation(spark, sf_dir):
    df = _record(spark, sf_dir).withColumn("grid", F.col("r.size").cast("int"))
    return df.select("p_partkey", json_records.valid(_RECORD, "r", df, list(range(1, 51)), "grid").alias("valid"))


@query("SELECT c_custkey, substr(sha256('salt:' || c_custkey), 1, 24) AS pseudonym, ('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % 100 < 10 AS flagged, ('0x' || substr(sha256('stream/' || c_custkey), 1, 15))::BIGINT AS seed FROM customer")
def digests(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", N.pseudonym("salt", k).alias("pseudonym"), N.hash_percent(F.sha2(k.cast("string"), 256), 10).alias("flagged"), N.digest_seed(F.concat(F.lit("stream/"), k.cast("string"))).alias("seed"))


@query("SELECT o_orderpriority AS label, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS index, count(*) AS n FROM orders GROUP BY ALL")
def label_indexes(spark, sf_dir):
    from quillon.operators.scoring import ordinal

    head = ordinal("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    o = table(spark, sf_dir, "orders").withColumn("index", head.index_of(F.col("o_orderpriority")))
    return o.groupBy(head.value_at(F.col("index")).alias("label"), "index").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate)) / 86400) AS BIGINT) AS days, CAST(ceil(len(o_orderpriority) / 4.0) AS BIGINT) AS tokens, CAST(floor(o_custkey * 0.15 + 0.5) AS BIGINT) AS share FROM orders")
def scalar_arithmetic(spark, sf_dir):
    later = F.to_timestamp_ntz(F.lit("2002-01-01"))
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", N.whole_days(later, F.col("o_orderdate")).alias("days"), N.token_estimate(F.length("o_orderpriority")).alias("tokens"), N.ratio_count(F.col("o_custkey"), 0.15).alias("share"))


# generators

_FIELDS = [Field("age_days", low=0, high=120, thresholds=(30, 60, 90)), Field("prior", low=0, high=8, thresholds=(3, 5)), Field("status", choices=("fraudulent", "paid")), Field("tier", choices=("enterprise", "standard"))]


def _draw(field: str, modulus: int, salt: str = "") -> str:
    return f"(('0x' || substr(sha256('stream:' || range || ':{field}{salt}'), 1, 12))::BIGINT % {modulus})"


def _number(f: Field) -> str:
    near = f"least(greatest([{', '.join(map(str, f.thresholds))}][{_draw(f.name, len(f.thresholds), '/t')} + 1] + {_draw(f.name, 3, '/o')} - 1, {f.low}), {f.high})"
    return f"CAST(CASE WHEN {_draw(f.name, 2, '/w')} = 0 THEN {near} ELSE {_draw(f.name, f.high - f.low + 1)} + {f.low} END AS BIGINT) AS {f.name}"


def _choice(f: Field) -> str:
    return f"[{', '.join(repr(c) for c in f.choices)}][{_draw(f.name, len(f.choices))} + 1] AS {f.name}"


_SAMPLE = "SELECT range AS row_id, " + ", ".join(_choice(f) if f.choices else _number(f) for f in _FIELDS) + " FROM range(2000)"


def _sample(spark):
    return generate.sample(spark, 2000, "stream", _FIELDS)


@query(_SAMPLE)
def typed_sample(spark, sf_dir):
    return _sample(spark)


_FIRST = f"s AS ({_SAMPLE})"
_LABEL = "CASE WHEN {a} > 90 THEN 'deny' WHEN {s} = 'fraudulent' THEN 'review' WHEN {a} > CASE WHEN {t} = 'enterprise' THEN 60 ELSE 30 END THEN 'deny' WHEN {p} >= 5 THEN 'review' ELSE 'approve' END"


def _edits_sql() -> str:
    parts = []
    for f in _FIELDS:
        values = [f"'{c}'" for c in f.choices] or [str(v) for t in f.thresholds for v in (t - 1, t, t + 1)]
        for v in values:
            twin = ", ".join(f"{v} AS t_{g.name}" if g.name == f.name else f"{g.name} AS t_{g.name}" for g in _FIELDS)
            parts.append(f"SELECT row_id, age_days, prior, status, tier, '{f.name}' AS path, CAST({f.name} AS VARCHAR) AS old, CAST({v} AS VARCHAR) AS new, {twin} FROM s WHERE {f.name} <> {v}")
    return " UNION ALL ".join(parts)


_EDITS = f"WITH {_FIRST}, e AS ({_edits_sql()})"


def _label(prefix: str = ""):
    c = lambda n: F.col(prefix + n)
    w = F.when(c("tier") == "enterprise", 60).otherwise(30)
    return F.when(c("age_days") > 90, "deny").when(c("status") == "fraudulent", "review").when(c("age_days") > w, "deny").when(c("prior") >= 5, "review").otherwise("approve")


def _edited(spark):
    return generate.edits(_sample(spark), _FIELDS, ["row_id"])


@query(_EDITS + " SELECT row_id, path, old, new FROM e")
def single_field_edits(spark, sf_dir):
    return _edited(spark).select("row_id", "path", "old", "new")


@query(_EDITS + " SELECT row_id, path, old, new, age_days > 90 AS held FROM e WHERE (age_days > 90) <> (t_age_days > 90)")
def boundary_pairs(spark, sf_dir):
    rule = F.col("age_days") > 90
    return _edited(spark).where(rule != (F.col("twin.age_days") > 90)).select("row_id", "path", "old", "new", rule.alias("held"))


_OLD, _NEW = _LABEL.format(a="age_days", s="status", t="tier", p="prior"), _LABEL.format(a="t_age_days", s="t_status", t="t_tier", p="t_prior")


@query(_EDITS + f", c AS (SELECT row_id, path, new, {_OLD} AS label, {_NEW} AS twin_label, row_number() OVER (PARTITION BY row_id ORDER BY path, new) AS rn FROM e WHERE {_OLD} <> {_NEW}) SELECT row_id, path, new, label, twin_label FROM c WHERE rn = 1")
def counterfactual_twins(spark, sf_dir):
    flips = _edited(spark).withColumns({"label": _label(), "twin_label": _label("twin.")}).where("label <> twin_label")
    first = datasets.first_of_each(flips.select("row_id", "path", "new", "label", "twin_label"), ["row_id"], [F.col("path"), F.col("new")])
    return first


_KEYED = "SELECT *, concat_ws('|', age_days, prior, status, tier) AS key FROM s"


@query(f"WITH {_FIRST}, k AS ({_KEYED}), known AS (SELECT key FROM k WHERE row_id % 10 = 0), u AS (SELECT key, min(CASE WHEN age_days IN (30, 31, 60, 61, 90, 91) THEN 0 WHEN row_id % 2 = 0 THEN 1 ELSE 2 END) AS o FROM k WHERE key NOT IN (SELECT key FROM known) GROUP BY key), r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY key) AS rn FROM u) SELECT key, CASE o WHEN 0 THEN 'boundary' WHEN 1 THEN 'interior' ELSE 'uniform' END AS origin FROM r WHERE rn <= CASE o WHEN 0 THEN 50 WHEN 1 THEN 100 ELSE 80 END")
def heldout_sample(spark, sf_dir):
    k = _sample(spark).withColumn("key", F.concat_ws("|", "age_days", "prior", "status", "tier"))
    edge = F.col("age_days").isin(30, 31, 60, 61, 90, 91)
    parts = [k.where(c).select("key") for c in (edge, ~edge & (F.col("row_id") % 2 == 0), ~edge & (F.col("row_id") % 2 == 1))]
    return datasets.quota_held_out(*parts, k.where("row_id % 10 = 0").select("key"), "key", (50, 100, 80))


@query("SELECT range AS row_id, ['approve', 'deny', 'review'][range % 3 + 1] AS output, CASE WHEN (range // 3) % 13 = 0 THEN 'none' WHEN (range // 3) % 13 % 2 = 1 THEN 'satisfy' ELSE 'near_miss' END AS what, CASE WHEN (range // 3) % 13 > 0 THEN CAST(((range // 3) % 13 - 1) // 2 AS INTEGER) END AS rule FROM range(500)")
def coverage_brief(spark, sf_dir):
    return generate.coverage_brief(spark.range(500).withColumnRenamed("id", "row_id"), "row_id", SUPPORT, 6)


@query(f"WITH {CASES}, x AS (SELECT case_id, status, expected FROM labelled) SELECT case_id, status, 'row' AS origin FROM x UNION ALL SELECT case_id, CASE WHEN status = 'paid' THEN 'fraudulent' ELSE 'paid' END, 'twin' FROM x")
def stale_status_twins(spark, sf_dir):
    x = ruled(spark, sf_dir).select("case_id", "status")
    twin = x.withColumn("status", F.when(F.col("status") == "paid", "fraudulent").otherwise("paid"))
    return datasets.union_all(("row", x), ("twin", twin))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return streams.windowed(e, "ts", "event_type", "value", "1 day").withColumn("total", F.round("total", 4))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "12 hours")


@query(f"WITH {SCORED} SELECT CASE WHEN confidence >= 0.7 THEN 'answered' ELSE 'missing' END AS event, count(*) AS n FROM scored GROUP BY 1")
def observation_events(spark, sf_dir):
    from quillon.operators.scoring import policy as decide

    calls = scored(spark, sf_dir).select(F.col("case_id").alias("call_id"), decide(F.col("diagnostic.value"), F.col("diagnostic.confidence"), 0.7)["outcome"].alias("outcome"))
    return streams.observations(calls).groupBy("event").agg(F.count("*").alias("n"))


@query(f"WITH {CASES} SELECT case_id, CASE WHEN age_days % 2 = 0 THEN 'yes' ELSE 'no' END AS answer FROM cases")
def stub_answers(spark, sf_dir):
    from quillon.sources.tables import answered_by

    answers = spark.createDataFrame([(i, "yes") for i in range(0, 120, 2)], "age_days long, answer string")
    return answered_by(ruled(spark, sf_dir), ["age_days"], answers, "no").select("case_id", "answer")


@query(f"WITH {CASES} SELECT case_id, expected AS label, true AS replaced FROM labelled WHERE expected <> CASE WHEN case_id % 2 = 0 THEN 'deny' ELSE 'approve' END")
def relabelled(spark, sf_dir):
    df = ruled(spark, sf_dir).withColumn("label", F.when(F.col("case_id") % 2 == 0, "deny").otherwise("approve"))
    new = F.coalesce(rules.rule_label(rules.admissible(policy(), SUPPORT)), F.col("label"))
    return df.where(new != F.col("label")).select("case_id", new.alias("label"), F.lit(True).alias("replaced"))
