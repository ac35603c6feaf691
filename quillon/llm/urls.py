"""URL rules and link-graph propagation of trust and distrust over hosts.

A url that a rule fits takes the rule's verdict, the longest rule first. All
others take their host's: a host is a trusted seed by each of its pages that a rule
allows and a distrusted one by each that a rule blocks. Trust
flows along links (a personalised PageRank that restarts at the trusted seeds),
distrust against them (the same on the reversed edges, from the distrusted
seeds: who links to bad hosts is suspect). Edges go between hosts: from the
absolute links of the pages, and between a host and the domain right above it
where both have pages. Both walks go on until what they could still move is a
hundredth of an average host's rank. A host is blocked where its distrust, on the
scale of an average host, exceeds a least value, and, a blocked page weighing as much as
an allowed one, `margin` times its trust.

DataFrame functions only. Pages are read once for their links and counted into
host edges with partial sums; both walks share one join per step, over tables
of hosts, cut by a durable table every few steps - every step where a host has so
many links that its join must be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, durable, fresh, small, table

#: The rules of the query: (verdict, host and path prefix).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
DAMPING, LEAST, MARGIN = 0.85, 0.1, 2.0
#: What may still move when the walks end, on the scale of an average host; steps to a durable table; links of a host from which each step has its own.
SETTLED, STEPS_AT_ONCE, HUB = 0.01, 5, 100_000
#: Absolute and scheme-relative link targets; up to the host's end. A tag's attributes hold no < here, so that unclosed tags cost linear time.
LINK = r"""(?i)<a\s[^<>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty for null or none."""
    rest = F.get(F.split(url, "://", 2), F.lit(1))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.get(F.split(url, "://", 2), F.lit(1))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. Of rules of one length the last in order of text wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w) between different hosts; w is how many pages link. pages: host, html."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)))
    linked = pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst")).where((F.col("src") != F.col("dst")) & (F.col("src") != ""))
    hosts = pages.select("host").where("host <> ''").distinct()
    above = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("dst")).join(hosts.select(F.col("host").alias("dst")), "dst").select("src", "dst")
    both = above.unionByName(above.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return linked.unionByName(both).groupBy("src", "dst").agg(F.count("*").alias("w"))


def walks(edges: DataFrame) -> tuple[DataFrame, int]:
    """(kind, src, dst, p): the links of both walks and how probably each is taken; and the most links of one host."""
    walk = edges.select(F.lit("trust").alias("kind"), "src", "dst", "w").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    out = durable(walk.groupBy("kind", "src").agg(F.sum("w").alias("all_w"), F.count("*").alias("links")), "url-out")
    most = out.agg(F.max("links")).first()[0] or 0
    walk = durable(walk.join(out.drop("links"), ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("all_w")).alias("p")), "url-walk")
    discard(out)
    return walk, most


def starts(seeds: DataFrame) -> DataFrame:
    """(kind, host, s): where the walks restart, each kind summing to one."""
    each = seeds.select(F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "s"), "host").where("s > 0")
    totals = each.groupBy("kind").agg(F.sum("s").alias("total"))  # two rows
    return durable(each.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("s") / F.col("total")).alias("s")), "url-seeds")


def moved(rank: DataFrame, walk: DataFrame, damping: float) -> DataFrame:
    step = rank.withColumnRenamed("host", "src").join(walk, ["kind", "src"])
    return step.groupBy("kind", F.col("dst").alias("host")).agg((F.sum(F.col("r") * F.col("p")) * damping).alias("r"))


def propagated(edges: DataFrame, seeds: DataFrame, steps: int | None = None, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """(host, trust, distrust), each summing to one over what the seeds reach. seeds: host, trust, distrust weights.
    steps: so many rounds of the walk with restarts; by default until all ranks are settled."""
    (walk, most), start = walks(edges), starts(seeds)
    rank = start.withColumnRenamed("s", "r")
    if walk.isEmpty():
        steps = 0
    for _ in range(steps or 0):
        lost = rank.join(walk.select("kind", F.col("src").alias("host")).distinct(), ["kind", "host"], "left_anti").groupBy("kind").agg(F.sum("r").alias("stuck"))
        # what restarts: the share 1 - d of all, and what stands on hosts without links (two rows at most)
        back = start.join(F.broadcast(lost), "kind", "left").select("kind", "host", (F.col("s") * (1 - damping + damping * F.coalesce("stuck", F.lit(0.0)))).alias("r"))
        rank = durable(moved(rank, walk, damping).unionByName(back).groupBy("kind", "host").agg(F.sum("r").alias("r")), "url-rank")
    if steps is None:
        rank = settle(walk, start, damping, settled, 1 if most > HUB else STEPS_AT_ONCE, seeds.count())
    pick = [F.sum(F.when(F.col("kind") == k, F.col("r")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")]
    return rank.groupBy("host").agg(*pick)


def settle(walk: DataFrame, start: DataFrame, damping: float, settled: float, at_once: int, hosts: int) -> DataFrame:
    """(kind, host, r) where the walks come to rest. What is lost on hosts without links restarts at the seeds, so the ranks are
    in proportion to those of walks that lose it: these are summed up, step by step, and brought to one at the end. A step adds no
    more than the share `damping` of what the one before added, which bounds all that is still to come."""
    rank, moving = start.select("kind", "host", (F.col("s") * (1 - damping)).alias("r")), 1.0
    while moving * hosts > settled:
        before = rank
        now = before
        for _ in range(at_once):
            now = moved(now, walk, damping).unionByName(start.select("kind", "host", (F.col("s") * (1 - damping)).alias("r"))).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        rank = durable(now, "url-rank")
        sums = [{r["kind"]: r["r"] for r in x.groupBy("kind").agg(F.sum("r").alias("r")).collect()} for x in (before, rank)]
        share = damping**at_once
        moving = max((sums[1][k] - sums[0].get(k, 0.0) for k in sums[1]), default=0.0) * share / (1 - share)
        discard(before)
    totals = rank.groupBy("kind").agg(F.sum("r").alias("total"))  # two rows
    return rank.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("r") / F.col("total")).alias("r"))


def judged(pages: DataFrame, rules=RULES, steps: int | None = None, damping: float = DAMPING, least: float = LEAST, margin: float = MARGIN) -> DataFrame:
    """All columns of pages, with host, path, rule and verdict.

    A null url, or one without ://, has an empty host and path, fits no rule and is
    allowed, as is every host that neither walk reaches; a null html has no links, one of
    any length is searched whole; repeated rows are judged alike and count as pages of their
    own; an empty table stays empty. Columns of pages that are named host, path, rule or
    verdict are replaced; all others are kept, whatever their names.
    """
    own = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    own = own.withColumn("rule", rule).withColumn("verdict", verdict)
    (name,) = fresh(own, "bad")
    per_host = own.where("host <> ''").groupBy("host").agg(F.count_if(F.col("verdict") == "allow").cast("double").alias("trust"), F.count_if(F.col("verdict") == "block").cast("double").alias("distrust"))
    seeds = durable(per_host, "url-hosts")
    edges = durable(host_edges(own.select("host", "html")), "url-edges")
    ranks = propagated(edges, seeds, steps, damping)
    facts = seeds.agg(F.count("*").alias("hosts"), F.sum("trust").alias("allowed"), F.sum("distrust").alias("blocked")).first()
    n = F.lit(float(max(1, facts["hosts"])))
    # each walk sums to one: weighed by its seeds, a blocked page counts as much as an allowed one
    worse = F.col("distrust") * F.lit(facts["blocked"] or 0.0) > F.col("trust") * F.lit((facts["allowed"] or 0.0) * margin)
    bad = durable(ranks.where(worse & (F.col("distrust") * n > least)).select(F.col("host").alias(name)), "url-bad")
    open_ = own.join(small(bad, bad.count()), F.col("host") == F.col(name), "left")
    return open_.withColumn("verdict", F.coalesce("verdict", F.when(F.col(name).isNotNull(), F.lit("block")).otherwise(F.lit("allow")))).drop(name)


def op7_url_filters(spark, sf_dir):
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
