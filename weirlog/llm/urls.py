"""URL filters: host and path rules, then trust and distrust spread over the link graph between hosts; native functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dimension, same, stage

#: (verdict, host, path prefix)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DAMPING = 0.85
#: Stop when a round adds less than this share to the rank of every host; a host that is newly reached gains all of its rank.
SETTLED = 1e-4
#: A host is blocked when its distrust is over this many times its trust.
TIMES = 1.0
LINK = r"""(?i)\b(?:href|src)\s*+=\s*+["']?\s*+(?:https?:)?//([^/"'?#\s>\\]++)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null or where there is no ://; A-Z of the host are lower-cased."""
    parts = r"(?s)^.*?://([^/?#]*+)([^?#]*+)"
    host = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def _matched(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; the rules are a short fixed list, so a CASE."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _spread(edges: DataFrame, seeds: DataFrame, rounds: int | None, damping: float) -> DataFrame:
    """Personalised PageRank: (host, rank) with restarts at seeds (host, seed), rank that finds no edge restarts too.

    Restarts only scale the ranks, so what the seeds send is summed path length by path length and divided by its total
    at the end. Sums only grow, and rounds go on until no host is new and none gains a share of SETTLED; rounds, if
    given, ends them earlier.
    """
    out = edges.groupBy("a").agg(F.sum("n").alias("all")).withColumnRenamed("a", "a2")
    out = stage(out, "urlout")
    steps = stage(edges.join(out, F.col("a") == F.col("a2")).select("a", "b", (F.col("n") / F.col("all")).alias("p")), "urlsteps")
    rank = seeds.select("host", F.col("seed").alias("rank"), F.col("seed").alias("gain"))
    if steps.limit(1).count() == 0:
        return rank.drop("gain")
    done = 0
    while rounds is None or done < rounds:
        sent = steps.join(rank.where("gain > 0"), F.col("a") == F.col("host")).groupBy("b").agg(F.sum(F.col("gain") * F.col("p") * damping).alias("got"))
        new = rank.select("host", "rank", F.lit(0.0).alias("gain")).unionByName(sent.select(F.col("b").alias("host"), F.col("got").alias("rank"), F.col("got").alias("gain")))
        rank = stage(new.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("gain").alias("gain")), "urlrank")
        done += 1
        if rank.where((F.col("gain") > 0) & (F.col("gain") >= SETTLED * F.col("rank"))).limit(1).count() == 0:
            break
    total = rank.agg(F.sum("rank")).first()[0]
    return rank.select("host", (F.col("rank") / F.lit(float(total or 1.0))).alias("rank"))


def graph_host(host: Column) -> Column:
    """A host as a node of the link graph: without user name and port."""
    return F.translate(F.regexp_replace(host, r"^[^@]*+@|:\d*+$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts, (a, b, n); pages has node and html."""
    links = pages.select(F.col("node").alias("host"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("to"))
    return links.select(F.col("host").alias("a"), graph_host(F.col("to")).alias("b")).where("a <> b and a <> '' and b <> ''").groupBy("a", "b").agg(F.count("*").alias("n"))


def url_filter(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    rules: Sequence[tuple[str, str, str]] = RULES, rounds: int | None = None, damping: float = DAMPING, times: float = TIMES,
) -> DataFrame:
    """A verdict for each page: the longest rule that fits, else its host's standing in the link graph.

    Seeds are the hosts of pages that rules decide: allowed pages give a host trust, blocked ones distrust, in
    proportion to their number. Trust follows links forwards, distrust backwards (who links to blocked hosts), both as
    personalised PageRank with restarts. A host is blocked when its distrust exceeds `times` its trust; a host that
    neither reaches is allowed. In the graph a host stands without user name and port. Hosts are counted before anything is spread, each round is staged, and the loop ends
    when no host is newly reached and no rank grows by a share of SETTLED.

    Null url, or one without ://: host and path empty, allowed. Null html: no links. Repeated rows count each. Empty
    table: no rows. Returns (page_id, host, path, rule, verdict, trust, distrust).
    """
    host, path = split_url(F.col(url_col))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html")).withColumn("node", graph_host(F.col("host")))
    rule, said = _matched(F.col("host"), F.col("path"), rules)
    edges = stage(host_edges(p), "urledges")
    p = p.drop("html").withColumns({"rule": rule, "said": said})
    seeds = p.where("node <> '' and said is not null").groupBy(F.col("node").alias("host")).agg(F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad"))
    seeds = stage(seeds, "urlseeds")
    total = seeds.agg(F.sum("good"), F.sum("bad")).first()
    side = lambda name, n: seeds.where(F.col(name) > 0).select("host", (F.col(name) / F.lit(float(n or 1))).alias("seed"))
    trust = _spread(edges, side("good", total[0]), rounds, damping)
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    distrust = _spread(back, side("bad", total[1]), rounds, damping)
    ranks = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust")))
    ranks = stage(ranks.groupBy(F.col("host").alias("d_node")).agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "urlranks")
    dim = dimension(ranks)
    p = p.join(dim, same(p, dim, "node"), "left").drop("d_node")
    p = p.withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    own = F.when(F.col("distrust") > times * F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))
    return p.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "trust", "distrust")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_CASE = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{n}}}'" for n, (_, h, p) in enumerate(sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))))
_LONGEST = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
#: Ranks are path sums of up to 60 links; links are read from the pages as the query does.
SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, html,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
p AS (SELECT page_id, html, host, path, regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', '') AS node, CASE @RULE END AS rule, CASE @SAID END AS said FROM u),
l AS (SELECT node AS a, unnest(list_distinct(regexp_extract_all(html, '(?i)\b(?:href|src)\s*=\s*["'']?\s*(?:https?:)?//([^/"''?#\s>\\]+)', 1))) AS t FROM p),
h AS (SELECT a, regexp_replace(regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[^@]*@', ''), ':[0-9]*$', '') AS b FROM l),
e AS (SELECT a, b, count(*)::DOUBLE AS n FROM h WHERE a <> b AND a <> '' AND b <> '' GROUP BY a, b),
ways AS (SELECT 'allow' AS side, a, b, n FROM e UNION ALL SELECT 'block', b, a, n FROM e),
steps AS (SELECT side, a, b, 0.85 * n / sum(n) OVER (PARTITION BY side, a) AS share FROM ways),
seeds AS (SELECT said AS side, node, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY said) AS seed FROM p WHERE said IS NOT NULL AND node <> '' GROUP BY said, node),
rec(round, side, node, gain) AS (
  SELECT 0, side, node, seed FROM seeds
  UNION ALL
  SELECT round + 1, rec.side, steps.b, sum(gain * share) FROM rec JOIN steps ON steps.side = rec.side AND steps.a = rec.node WHERE round < 60 GROUP BY round, rec.side, steps.b),
ranks AS (SELECT side, node, sum(gain) / sum(sum(gain)) OVER (PARTITION BY side) AS rank FROM rec GROUP BY side, node)
SELECT p.page_id, p.host, p.path, p.rule,
  coalesce(p.said, CASE WHEN coalesce(d.rank, 0) > coalesce(t.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(t.rank, 0) AS trust, coalesce(d.rank, 0) AS distrust
FROM p LEFT JOIN ranks t ON t.node = p.node AND t.side = 'allow' LEFT JOIN ranks d ON d.node = p.node AND d.side = 'block'
"""
SQL = SQL.replace("@RULE", _CASE.format(*[h + p for _, h, p in _LONGEST])).replace("@SAID", _CASE.format(*[w for w, _, _ in _LONGEST]))
