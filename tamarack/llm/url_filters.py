"""URL filters: rules by longest match, and link-graph propagation over hosts for what no rule fits.

Hosts whose pages the allow rules admit are trusted seeds, hosts whose pages the block rules refuse are
blocked seeds, each by its share of such pages. Trust flows along host edges (links between hosts,
and between a host and the domain above it) as personalised PageRank; distrust flows against them.
Both flow in the same rounds until what is left to come is too little to matter. A host is blocked
where its distrust is larger than its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if, discard, stored, unused

#: (host, start of the path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
DAMPING, CUT_EVERY = 0.85, 5
#: Rounds end once all scores together can grow by no more than this share of an average host's score.
TOLERANCE = 0.01
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*([a-z][a-z0-9+.-]*://[^\s"'<>]*)"""


def host_of(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without it."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule (host, then path) that fits, or null."""
    best = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule_host, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(start)
        best = F.when(fits, F.struct(F.lit(rule_host + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _domain_steps(host: Column) -> Column:
    """(host, domain above) for a host and each domain above it, down to two labels."""
    parts = F.split(host, r"\.")
    name = lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts) - 2), lambda i: F.struct(name(i).alias("src"), name(i + 1).alias("dst")))
    return F.when(F.size(parts) > 2, steps)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): how many links lead from pages of one host to another host, plus one edge each
    way between a host and the domain above it. Links inside a host, and relative ones, are none."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)))).alias("to"))
    out = links.select(F.col("host").alias("src"), host_of(F.col("to")).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    out = out.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    hosts = pages.where("host <> ''").select("host").distinct().union(out.select("dst")).distinct()
    up = hosts.select(F.explode(_domain_steps(F.col("host"))).alias("s")).select("s.*").distinct()
    both = up.union(up.select("dst", "src")).withColumn("w", F.lit(1.0))
    return out.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score): PageRank over ``edges`` (kind, src, dst, w) that restarts at ``seeds`` (kind, host, share).

    Each kind is a graph of its own, whose shares sum to one. What flows into hosts without edges out is
    given up, so scores need not sum to one. They only grow from round to round, by at most ``damping``
    of the growth before; so the growth over some rounds bounds all that is still to come. Each round
    is one join and one aggregation; every few rounds the scores are stored and summed. The result
    is a stored table.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("total"))
    steps = stored(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (damping * F.col("w") / F.col("total")).alias("p")), "steps")
    start = stored(seeds.select("kind", "host", (F.col("share").cast("double") * (1 - damping)).alias("s")), "start")
    score, before = stored(start.withColumnRenamed("s", "score"), "score"), 0.0
    hosts = steps.select(F.col("kind"), F.col("src").alias("host")).union(steps.select("kind", "dst")).union(start.select("kind", "host")).distinct().count()
    moves = broadcast_if(steps.withColumnsRenamed({"src": "host"}))
    shrunk = damping**CUT_EVERY
    while True:
        last = score
        for _ in range(CUT_EVERY):
            flown = moves.join(score, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("p") * F.col("score")).alias("s"))
            score = flown.union(start).groupBy("kind", "host").agg(F.sum("s").alias("score"))
        score = stored(score, "score")
        discard(last)
        total = score.agg(F.sum("score")).first()[0] or 0.0
        if (total - before) * shrunk / (1 - shrunk) * max(hosts, 1) <= tolerance:
            discard(steps, start)
            return score
        before = total


def _seeds(counts: DataFrame, column: str, kind: str) -> DataFrame:
    total = counts.agg(F.sum(column)).first()[0] or 0
    return counts.where(F.col(column) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(column) / F.lit(max(total, 1))).alias("share"))


def host_scores(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) for every host that trust or distrust reaches, as a stored table."""
    judged = pages.select("host", matching_rule(F.col("host"), F.col("path"), rules)["verdict"].alias("v"), "html")
    marked = judged.where("host <> ''").groupBy("host").agg(*(F.sum(F.coalesce(F.col("v") == v, F.lit(False)).cast("long")).alias(v) for v in ("allow", "block")))
    counts = stored(marked, "seeds")
    edges = stored(host_edges(pages), "hosts")
    against = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "w").union(against)
    flowed = personalised_pagerank(both, _seeds(counts, "allow", "trust").union(_seeds(counts, "block", "distrust")), damping, tolerance)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    out = stored(flowed.groupBy("host").agg(of("trust"), of("distrust")), "scores")
    discard(counts, edges, flowed)
    return out


def judge_urls(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, margin: float = 0.0) -> DataFrame:
    """``pages`` (url, html) with host, path, rule, trust, distrust and verdict (allow or block).

    A rule's verdict stands; without one, a host is blocked if distrust exceeds trust by more than
    ``margin``, else (ties too) allowed. A null url or one without `://` has empty host and path, no
    scores and is allowed; null html has no links. Rows are judged one by one, so repeated rows repeat;
    urls and pages of any length are read whole; an empty table gives no rows. Of the columns
    added, those that ``pages`` has already are replaced; all others stay, whatever their names. Hosts'
    scores are joined to pages by host: small ones are broadcast, else a hot host's pages may be split.
    """
    placed = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    scores = host_scores(placed.select("host", "path", "html"), rules, damping, tolerance)
    of, good, bad = (unused(name, placed.columns) for name in ("of_host", "good", "bad"))
    found = broadcast_if(scores.select(F.col("host").alias(of), F.col("trust").alias(good), F.col("distrust").alias(bad)))
    joined = placed.join(found, (F.col("host") == F.col(of)) & (F.col("host") != ""), "left")
    match = matching_rule(F.col("host"), F.col("path"), rules)
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in (good, bad))
    verdict = F.coalesce(match["verdict"], F.when(distrust > trust + margin, "block").otherwise("allow"))
    new = {"rule": match["rule"], "trust": trust, "distrust": distrust, "verdict": verdict}
    return joined.withColumns(new).drop(of, good, bad)


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))
