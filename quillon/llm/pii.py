"""Personal data: base spans by pattern, and information-theoretic sanitisation.

Base spans (e-mail, ip, card, phone) are the protected entities; so is what several of
them share: an e-mail's domain, the first digits of a number, the network of an address.
What else tells entities apart is estimated from the corpus: for an entity e and a term t
of the words around its mentions, PMI(e; t) = log2(N n(e, t) / (n(e) n(t))) is measured
against the entity's information IC(e) = log2(N / n(e)). n() counts rows, over all of
them. A term that reveals a share `alpha` of IC(e) exceeds the disclosure threshold, if
it stands beside e in at least `support` different texts (in one, chance can't be told
from knowledge, and exact copies are one): it is removed where it reveals (nearly) all of
it, and generalised to [TERM] otherwise, in every document in which it stands.

DataFrame functions only. Contexts are linear in the mentions; terms, contexts
and spans are counted by key with partial sums, and a small side is broadcast
only after its rows are counted, joined by key beyond the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, durable, fresh, small, table

#: The base patterns, in the order in which kinds are listed. Each is the contract's pattern with
#: possessive groups (nothing that they give back could make a match) and a start that can't lie inside
#: a run whose beginning failed, so that long runs cost linear time.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
TERM = r"[\p{L}][\p{L}\p{N}_'-]*+"
#: Words on either side of a mention, characters in which they are looked for first, evidence, and the shares of an entity's information.
CONTEXT_WORDS, CONTEXT_CHARS, SUPPORT, ALPHA, ALL_OF_IT = 6, 160, 2, 0.85, 0.98
SPAN = "struct<kind:string,start:int,end:int,value:string>"
#: Items that are folded at once; so the results of a long text aren't copied for each of them.
FOLDED = 256


def bound(value: Column, make) -> Column:
    """make(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def folded(items: Column, state: Column, step, kind: str) -> Column:
    """What step(state, item) -> (state, array of `kind`) gives for each item, one after the other."""
    return bound(items, lambda its: _folded(its, state, step, kind))


def _folded(items: Column, state: Column, step, kind: str) -> Column:
    none = F.array().cast(f"array<{kind}>")

    def block(acc: Column, at: Column) -> Column:
        def one(inner: Column, item: Column) -> Column:
            now, out = step(inner["state"], item)
            return F.struct(now.alias("state"), F.concat(inner["out"], out).alias("out"))

        got = F.aggregate(F.slice(items, at * FOLDED + 1, F.lit(FOLDED)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return bound(got, lambda g: F.struct(g["state"].alias("state"), F.array_append(acc["blocks"], g["out"]).alias("blocks")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLDED).cast("int"))
    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("blocks"))
    return F.when(F.size(items) > 0, F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["blocks"]))).otherwise(none)


def located(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Every match of a pattern with its place in code points; only those for which keep(value) holds."""
    none = F.array().cast(f"array<{SPAN}>")

    def add(at: Column, pair: Column) -> tuple[Column, Column]:
        start = at + F.length(pair["0"])
        end = start + F.length(pair["1"])
        span = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["1"].alias("value")))
        return end, span if keep is None else F.when(keep(pair["1"]), span).otherwise(none)

    def of(found: Column) -> Column:
        pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("0"), found.alias("1"))
        return F.when(F.size(found) > 0, folded(pairs, F.lit(0), add, SPAN)).otherwise(none)

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """number: a string of digits."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(d == "", 0).otherwise(_doubled(d.cast("int"), i)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _doubled(d: Column, i: Column) -> Column:
    return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))


def small_part(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(F.when(F.length(bare).between(1, 3), bare).cast("int"), F.lit(0)) <= 255)


def base_spans(text: Column) -> Column:
    """The valid base spans, by kind as listed, then by start."""
    has = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    none = F.array().cast(f"array<{SPAN}>")
    every = {k: F.when(has[k], located(text, PATTERNS[k], k)).otherwise(none) for k in KINDS}
    every["ip"] = F.filter(every["ip"], lambda s: F.forall(F.split(s["value"], r"\."), small_part))
    every["card"] = F.filter(every["card"], lambda s: F.length(digits(s["value"])).between(13, 19) & passes_luhn(digits(s["value"])))
    every["phone"] = F.filter(every["phone"], lambda s: F.length(digits(s["value"])).between(9, 15))
    return F.concat(*[every[k] for k in KINDS])


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def lower_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def beside(text: Column, span: Column) -> Column:
    """The nearest words on either side of a span. They are looked for in a few characters, of which a word that may be cut is
    left out; where these hold too few, in all of the text on that side."""
    near, most = F.lit(CONTEXT_CHARS), F.lit(CONTEXT_WORDS)
    begins, ends = span["start"] <= near, span["end"] + near >= F.length(text)

    def words_of(window: Column, whole: Column, complete: Column, cut, pick) -> Column:
        enough = lambda ws: F.when(complete | (F.size(cut(ws)) >= most), pick(F.when(complete, ws).otherwise(cut(ws))))
        return F.coalesce(bound(lower_terms(window), enough), bound(lower_terms(whole), pick))

    rest = lambda ws: F.greatest(F.lit(0), F.size(ws) - 1)
    left = words_of(
        F.substring(text, F.greatest(F.lit(1), span["start"] - near + 1), F.least(near, span["start"])), F.substring(text, F.lit(1), span["start"]), begins,
        lambda ws: F.slice(ws, F.lit(2), rest(ws)), lambda ws: F.slice(ws, F.greatest(F.lit(0), F.size(ws) - most) + 1, most),
    )
    right = words_of(F.substring(text, span["end"] + 1, near), F.substring(text, span["end"] + 1, F.length(text)), ends, lambda ws: F.slice(ws, F.lit(1), rest(ws)), lambda ws: F.slice(ws, F.lit(1), most))
    return F.concat(left, right)


def entities(span: Column) -> Column:
    """What a base span is a mention of: its value, and what it shares with others of its kind."""
    kind, value = span["kind"], F.lower(span["value"])
    number = digits(value)
    shared = F.when(kind == "email", F.regexp_extract(value, "@(.*)$", 1)).when(kind == "ip", F.regexp_extract(value, r"^(.*)\.[0-9]+$", 1)).otherwise(F.substring(number, 1, 6))
    return F.array(*[F.sha2(F.concat_ws(":", F.lit(level), kind, v), 256) for level, v in (("value", F.when(kind == "email", value).when(kind == "ip", value).otherwise(number)), ("shared", shared))])


def mentioned(spotted: DataFrame) -> DataFrame:
    """(row, print, entity, terms): a row for each mention's entities. spotted: text, spans."""
    mention = spotted.where(F.size("spans") > 0).select(F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("print"), "text", F.explode("spans").alias("s"))
    around = mention.select("row", "print", entities(F.col("s")).alias("es"), F.array_distinct(beside(F.col("text"), F.col("s"))).alias("terms"))
    return around.select("row", "print", F.explode("es").alias("entity"), "terms")


def pairs_of(around: DataFrame, total: int, support: int, alpha: float) -> DataFrame:
    """(entity, term, n_et, n_e): pairs with enough evidence that may reach alpha."""
    known = around.select("entity", "row").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    each = around.select("entity", "print", "row", F.explode("terms").alias("term")).distinct()
    # n(t) is at least the number of rows whose contexts hold t: a term that is too common even so can't reach alpha
    near = each.select("term", "row").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    pairs = each.groupBy("entity", "term", "print").agg(F.count("*").alias("rows")).groupBy("entity", "term").agg(F.sum("rows").alias("n_et"), F.count("*").alias("texts"))
    most = F.col("n_et") * F.pow(F.lit(float(total)) / F.col("n_e"), 1 - alpha)
    return pairs.where(F.col("texts") >= support).join(known, "entity").join(near, "term").where(F.col("n_near") <= most * 1.000001).select("entity", "term", "n_et", "n_e")


def disclosing(spotted: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """(term, share): terms that reveal at least alpha of some entity's information; share is the most that it reveals.
    spotted: text, spans of all documents."""
    total = spotted.count()
    around = durable(mentioned(spotted), "pii-contexts")
    pairs = durable(pairs_of(around, total, support, alpha), "pii-pairs")
    asked = durable(pairs.select("term").distinct(), "pii-terms")
    discard(around)
    n_asked = asked.count()
    if not n_asked:
        return asked.withColumn("share", F.lit(0.0))
    words = spotted.select(F.explode(F.array_distinct(lower_terms(F.col("text")))).alias("term"))
    df = words.join(small(asked, n_asked), "term").groupBy("term").agg(F.count("*").alias("n_t"))
    measured = pairs.join(df, "term")
    ic = F.log2(F.lit(float(total)) / F.col("n_e"))
    pmi = F.log2(F.lit(float(total)) * F.col("n_et") / (F.col("n_e") * F.greatest("n_t", "n_et")))
    shares = measured.where(ic > 0).groupBy("term").agg(F.max(pmi / ic).alias("share"))
    return shares.where(F.col("share") >= alpha)


def marked(docs: DataFrame, names: list[str], support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """All columns of docs, and four under the given names (none of docs'): the text, base spans, all spans, removed terms."""
    text_, base_, spans_, removed_ = names
    key, terms_ = fresh(docs, "print", "terms")
    text = F.coalesce(F.col("text"), F.lit(""))
    spotted = docs.select(text.alias("text")).withColumn("spans", base_spans(F.col("text")))
    terms = durable(disclosing(spotted, support, alpha), "pii-disclosing")
    n_terms = terms.count()
    out = docs.withColumn(text_, text).withColumn(base_, base_spans(F.col(text_)))
    if not n_terms:
        return out.withColumn(spans_, F.col(base_)).withColumn(removed_, F.array().cast("array<string>"))
    # by text, not by doc_id: equal texts hold the same terms, whatever ids they stand under
    held = spotted.select(F.xxhash64("text").alias(key), F.explode(F.array_distinct(lower_terms(F.col("text")))).alias("term")).join(small(terms, n_terms), "term")
    held = held.groupBy(key).agg(F.collect_set("term").alias(terms_), F.collect_set(F.when(F.col("share") >= ALL_OF_IT, F.col("term"))).alias(removed_))
    held = durable(held, "pii-documents")
    discard(terms)
    out = out.withColumn(key, F.xxhash64(text_)).join(small(held, held.count()), key, "left")
    extra = located(blanked(F.col(text_), F.col(base_)), TERM, "term", lambda v: F.array_contains(F.col(terms_), F.lower(v)))
    none = F.array().cast(f"array<{SPAN}>")
    spans = F.concat(F.col(base_), F.when(F.col(terms_).isNull(), none).otherwise(extra))
    return out.withColumn(spans_, spans).withColumn(removed_, F.coalesce(removed_, F.array().cast("array<string>"))).drop(terms_, key)


def judged(docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """All columns of docs, with `spans` (base, then terms), `base` (the base ones alone) and `removed` (terms that are removed,
    not generalised); columns of docs that are named so are replaced, all others are kept.

    A null text is empty and has no spans; a text of any length is searched whole; repeated rows count as
    often as they occur, but equal texts are one as evidence, and each row gets its spans; a null doc_id
    changes nothing. Where base spans overlap all are listed; terms lie outside of them. Terms are matched in
    lower case. An empty table stays empty.
    """
    mine = ("spans", "base", "removed")
    rest = docs.drop(*mine)
    names = fresh(rest, "text", "base", "spans", "removed")
    out = marked(rest, names, support, alpha)
    return out.select(*rest.columns, F.col(names[2]).alias("spans"), F.col(names[1]).alias("base"), F.col(names[3]).alias("removed"))


def replaced(text: Column, spans: Column, mark) -> Column:
    """The text with every span replaced by mark(span); of spans that overlap the first (then longest) names the whole."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))

    def add(at: Column, s: Column) -> tuple[Column, Column]:
        # a span that begins inside another one but ends beyond it lengthens the gap
        end, inside = -s["end"], s["start"] < at
        rest = F.array(F.substring(text, at + 1, s["start"] - at), mark(s["kind"], s["value"]))
        return F.greatest(at, end), F.when(inside, F.array(mark(F.lit(None).cast("string"), F.repeat(F.lit(" "), F.greatest(F.lit(0), end - at))))).otherwise(rest)

    parts = folded(ordered, F.lit(0), add, "string")
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the spans, as long."""
    return replaced(text, spans, lambda kind, value: F.repeat(F.lit(" "), F.length(value)))


def redacted(text: Column, spans: Column, removed: Column) -> Column:
    """The text with every span replaced by its kind, a removed term by nothing."""

    def mark(kind: Column, value: Column) -> Column:
        bare = kind.isNull() | ((kind == "term") & F.array_contains(removed, F.lower(value)))
        return F.when(bare, F.lit("")).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))

    return replaced(text, spans, mark)


def sanitised(docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """The documents, columns as they are and whatever their names, with personal data taken out of text. A null text stays null."""
    columns = docs.columns
    names = fresh(docs, "text", "base", "spans", "removed")
    out = marked(docs, names, support, alpha)
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), redacted(*(F.col(names[i]) for i in (0, 2, 3)))))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def _is(kind: str):
    return lambda x: x == kind


def op4_pii(spark, sf_dir):
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base")
    counts = [F.size(F.filter(F.transform(base, lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
