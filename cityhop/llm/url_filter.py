"""URL filter: rules, and link-graph propagation for what no rule decides.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path: from there up to ``?``, ``#`` or the
end.  A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; of several, the one with
the longest host and path wins (a block if they are equally long).

Links are the ``href`` values with a host of their own; host edges carry the share of the host's links.  A host's restart value is the share
of its pages that a rule allows (trust) or blocks (distrust).  Trust walks along edges, distrust against them, as personalised
PageRank with ``damping``; walks end at hosts without a way on.  Beside each score goes the rank: the same walk from all hosts
alike.  A host's trust and distrust are shares, score by rank (its own part only counts if a rule decides one of its pages), so they
do not turn on how many hosts a seed's walk is dealt among.  Steps go on until no share moves by more than ``tolerance`` (each step
shrinks what is left by ``damping``).  A host whose distrust exceeds its trust by more than ``threshold`` is blocked, else allowed.

Null urls, and urls without ``://``, have empty host and path, which no rule fits and which are allowed: they have no edges and are no host.
Null pages have no links.  Repeated rows are pages of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityhop.llm.scratch import written

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
HREF = r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the winning rule, or nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "block", r))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def judged(pages: DataFrame, id_col: str, url_col: str, rules) -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return rows.withColumn("rule", name).withColumn("verdict", verdict)


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts."""
    host, _ = host_and_path(F.col(url_col))
    links = pages.select(host.alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(HREF), F.lit(1)))).alias("link"))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    to, _ = host_and_path(absolute)
    return links.select("src", to.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(edges: DataFrame, restart: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, stride: int = 4, keep: bool = True) -> DataFrame:
    """(host, trust, distrust) to the scores after propagation; ``restart`` has every host of ``edges`` or misses it as 0.

    ``trust_in`` and ``distrust_in`` are what a host gets from others when all hosts restart at 1.  A host without a way on
    keeps its walk, or (not ``keep``) ends it.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("total"))
    forward = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("links") / F.col("total")).alias("w"))
    backward = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("links") / F.col("total")).alias("w"))
    walks = forward.unionByName(backward)
    hosts = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).unionByName(restart.select("host")).distinct()
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(k, F.lit(0.0)).alias("s")) for k in ("trust", "distrust")]))
    base = hosts.join(restart, "host", "left").select("host", kinds.alias("x")).select("x.kind", "host", "x.s")
    if keep:
        stuck = base.join(walks.select("kind", F.col("a").alias("host")).distinct().withColumn("goes", F.lit(True)), ["kind", "host"], "left")
        walks = walks.unionByName(stuck.where("goes is null").select("kind", F.col("host").alias("a"), F.col("host").alias("b"), F.lit(1.0).alias("w")))
    walks = written(walks)
    base = written(base)
    score = base.select("kind", "host", F.col("s").alias("p"), F.lit(damping).alias("m"))
    # nothing moves that starts at its walk's end: the first stride then changes nothing
    while True:
        new = score
        for _ in range(stride):
            rank = 1 - damping + F.col("m")
            moved = walks.join(new.withColumnRenamed("host", "a"), ["kind", "a"]).groupBy("kind", F.col("b").alias("host"))
            moved = moved.agg((damping * F.sum(F.col("w") * F.col("p"))).alias("got"), (damping * F.sum(F.col("w") * rank)).alias("m"))
            new = base.join(moved, ["kind", "host"], "left").select(
                "kind", "host", ((1 - damping) * F.col("s") + F.coalesce("got", F.lit(0.0))).alias("p"), F.coalesce("m", F.lit(0.0)).alias("m")
            )
        new = written(new)
        moves = F.abs(F.col("p") - F.col("p0")) + F.abs(F.col("m") - F.col("m0"))
        # against what the host gets, however many share it
        part = F.when(F.col("m") > 0, F.least(F.lit(1.0), "m")).otherwise(1.0)
        far = new.join(score.select("kind", "host", F.col("p").alias("p0"), F.col("m").alias("m0")), ["kind", "host"]).agg(F.max(moves / part)).first()[0]
        score = new
        if (far or 0.0) <= tolerance:
            break
    return score.groupBy("host").agg(
        *[F.max(F.when(F.col("kind") == k, F.col(c))).alias(k + end) for k in ("trust", "distrust") for c, end in (("p", ""), ("m", "_in"))]
    )


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules=RULES,
    threshold: float = 0.5,
    damping: float = 0.85,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust, distrust (shares, of its host; null without one)."""
    rows = written(judged(pages, id_col, url_col, rules))
    share = {k: F.avg((F.coalesce("verdict", F.lit("")) == v).cast("double")).alias(k) for k, v in (("trust", "allow"), ("distrust", "block"))}
    restart = rows.where("host <> ''").groupBy("host").agg(*share.values())
    restart = written(restart)
    walked = propagate(written(host_edges(pages, url_col, html_col)), restart, damping, keep=False)
    ruled = restart.select("host", (F.col("trust") + F.col("distrust") > 0).alias("ruled"))

    def part(k: str) -> Column:
        rank = F.col(k + "_in") + F.when(F.col("ruled"), 1 - damping).otherwise(0.0)
        return F.when(rank > 0, F.col(k) / rank).otherwise(0.0).alias(k)

    scores = written(walked.join(ruled, "host", "left").select("host", part("trust"), part("distrust")))
    verdict = F.coalesce("verdict", F.when(F.col("distrust") - F.col("trust") > threshold, "block"), F.lit("allow"))
    return rows.join(scores, "host", "left").select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
