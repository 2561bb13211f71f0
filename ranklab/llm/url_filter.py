"""URL verdicts: explicit rules, and trust that spreads over the link graph of hosts for what no rule decides.

Hosts whose pages the rules mostly allow are trusted seeds, those whose pages they mostly block are blocked seeds. Trust
is a personalised PageRank along links from the trusted seeds; distrust is one against the direction of links from the
blocked seeds, since linking to a blocked host speaks against the one who links. A host is blocked if distrust prevails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ranklab.llm.common import written
from ranklab.session import union_all

DAMPING = 0.85
#: Ranks spread for ROUNDS rounds, and on by ROUNDS_AT_ONCE until those move less than SETTLED of all rank. What is still
#: under way shrinks by DAMPING every round, so that ends whatever the graph.
ROUNDS = 20
ROUNDS_AT_ONCE = 5
SETTLED = 1e-9
#: A host is a seed if more than this share of its pages has one rule verdict, and is blocked if its distrust is more
#: than THRESHOLD of its trust and distrust together.
SEED_SHARE = 0.5
THRESHOLD = 0.5
#: Ranks whose relative difference is less are equal; sums in another order differ by less.
TIE = 1e-11
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """`pattern` is a host and a path, like `example.org/fr/`; the list is a parameter, a few thousand rules at most."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host):]


def host_of(url: Column) -> Column:
    """From behind the first :// to /, ? or # or the end, A-Z lowered; empty if there is no ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits (a struct of pattern and verdict), or null. Of equally long ones the first wins."""
    out = F.lit(None).cast("struct<pattern: string, verdict: string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.pattern).alias("pattern"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Links between different hosts as (src, dst, links), from absolute addresses in href attributes. Counts are
    combined before the shuffle; relative links stay on their host and carry nothing."""
    found = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(
        F.col(html_col), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    found = found.select("src", host_of(to).alias("dst")).filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return found.groupBy("src", "dst").agg(F.count("*").cast("double").alias("links"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """Personalised PageRank, both kinds at once: (kind, host, rank), `trust` along links and `distrust` against them.

    `seeds` is (kind, host). Ranks of a kind start at its seeds and add to at most 1; what reaches a host without
    further links leaves. Ranks are written every few rounds, and after `rounds` of them the rounds go on until a few move
    the ranks of either kind by no more than `settled` in sum; without links the seeds keep their start.
    """
    both = union_all([links.select(F.lit("trust").alias("kind"), "src", "dst", "links"),
                      links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links")])
    total = both.groupBy("kind", "src").agg(F.sum("links").alias("total"))
    share = written(both.join(total, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("links") / F.col("total")).alias("share")), "host-links")
    size = seeds.groupBy("kind").agg(F.count("*").alias("size"))
    start = written(seeds.join(size, "kind").select("kind", "host", (1.0 / F.col("size")).alias("rank")), "seeds")
    if share.isEmpty():
        return start
    rank = start
    done, moved = 0, float("inf")
    while done < rounds or moved > settled:
        new = rank
        for _ in range(ROUNDS_AT_ONCE):
            sent = new.join(share, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
            back = start.select("kind", "host", (F.col("rank") * (1 - damping)).alias("rank"))
            new = union_all([sent, back]).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        new = written(new, "ranks")
        done += ROUNDS_AT_ONCE
        if done >= rounds:
            change = union_all([new, rank.select("kind", "host", (-F.col("rank")).alias("rank"))]).groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("rank"))
            moved = change.agg(F.sum("rank")).first()[0] or 0.0
        rank = new
    return rank


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, `host`, `path`, `rule` (the longest that fits, else null), `verdict` (`allow` or `block`: the rule's,
    else the host's) and the `trust` and `distrust` of its host.

    A null url or one without :// has an empty host and path, no rule, and is allowed, like every host that neither rank
    reaches. Rows with null or repeated ids are judged one by one; a null html has no links.
    """
    rows = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    share = rows.filter("host != ''").groupBy("host").agg(
        F.count("*").alias("n"), *[F.count(F.when(F.col("_rule.verdict") == v, 1)).alias(v) for v in ("allow", "block")])
    hosts = written(share, "hosts")
    seeds = union_all([hosts.filter(F.col("allow") > F.col("n") * SEED_SHARE).select(F.lit("trust").alias("kind"), "host"),
                       hosts.filter(F.col("block") > F.col("n") * SEED_SHARE).select(F.lit("distrust").alias("kind"), "host")])
    ranks = propagate(host_links(pages, url_col, html_col), seeds)
    ranks = ranks.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
    judged = rows.join(ranks, "host", "left").fillna(0.0, ["trust", "distrust"])
    # Ranks shrink with the number of seeds and with every degree on the way, so only what is shown is rounded.
    bad = F.col("distrust") > (F.col("trust") + F.col("distrust")) * (THRESHOLD * (1 + TIE))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(bad, "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", F.col("_rule.pattern").alias("rule"), verdict.alias("verdict"),
                         *[F.round(k, 12).alias(k) for k in ("trust", "distrust")])


def oracle(rules: tuple[UrlRule, ...], n_rounds: int = ROUNDS) -> str:
    """The same in SQL, every round written out; for tables whose ranks have settled by the last round."""
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    host = lambda url: lower.format(f"regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1)")
    fits = " ".join(f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}') THEN '{r.pattern}'"
                    for r in sorted(rules, key=lambda r: -len(r.pattern)))
    verdict = " ".join(f"WHEN '{r.pattern}' THEN '{r.verdict}'" for r in rules)
    rounds = ""
    for k in range(1, n_rounds + 1):
        rounds += f""",
r{k} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (SELECT kind, host, rank * {1 - DAMPING} AS rank FROM r0
  UNION ALL SELECT e.kind, e.dst, r.rank * e.links / t.total * {DAMPING} FROM r{k - 1} r JOIN e ON e.kind = r.kind AND e.src = r.host JOIN t ON t.kind = e.kind AND t.src = e.src) GROUP BY ALL)"""
    return f"""
WITH p AS (SELECT page_id, html, coalesce({host('url')}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT *, CASE {fits} END AS rule FROM p),
v AS (SELECT *, CASE rule {verdict} END AS said FROM j),
s AS (SELECT host, count(*) AS n, count(*) FILTER (said = 'allow') AS allow, count(*) FILTER (said = 'block') AS block FROM v WHERE host <> '' GROUP BY host),
q AS (SELECT 'trust' AS kind, host FROM s WHERE allow > n * {SEED_SHARE} UNION ALL SELECT 'distrust', host FROM s WHERE block > n * {SEED_SHARE}),
l AS (SELECT host AS src, {host("CASE WHEN prefix(x, '//') THEN 'http:' || x ELSE x END")} AS dst
      FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?\\s*((?:https?:)?//[^"''\\s>]+)', 1)) AS x FROM p)),
c AS (SELECT src, dst, count(*)::DOUBLE AS links FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
e AS (SELECT 'trust' AS kind, * FROM c UNION ALL SELECT 'distrust', dst, src, links FROM c),
t AS (SELECT kind, src, sum(links) AS total FROM e GROUP BY ALL),
r0 AS MATERIALIZED (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS rank FROM q){rounds},
f AS (SELECT host, round(coalesce(sum(rank) FILTER (kind = 'trust'), 0), 12) AS trust, round(coalesce(sum(rank) FILTER (kind = 'distrust'), 0), 12) AS distrust
      FROM (SELECT * FROM {{ranks}}) GROUP BY host)
SELECT page_id, v.host, path, rule, coalesce(said, CASE WHEN coalesce(distrust, 0) > (coalesce(trust, 0) + coalesce(distrust, 0)) * {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0.0) AS trust, coalesce(distrust, 0.0) AS distrust
FROM v LEFT JOIN f ON f.host = v.host
""".replace("{ranks}", f"r{n_rounds} WHERE (SELECT count(*) FROM c) > 0 UNION ALL SELECT * FROM r0 WHERE (SELECT count(*) FROM c) = 0")
