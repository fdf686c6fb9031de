"""URL filter: rules, and trust that spreads over the graph of hosts.

A url that a rule covers gets the rule's verdict; the longest rule wins. The others are judged by their host:
hosts most of whose pages are allowed by rules are trusted seeds, hosts most of whose pages are blocked are
distrusted seeds. Personalised PageRank spreads trust along the links between hosts from the trusted seeds;
the same over reversed links spreads distrust from the blocked ones (who links to a blocked host is suspect).
A host is blocked if its distrust exceeds its trust by ``threshold`` or more.

Only DataFrame functions are used. Pages are pre-aggregated to hosts and to weighted pairs of hosts before
anything is joined; ranks are joined to links by host, round after round until they stand still within ``tolerance``,
and every few rounds they are checkpointed. A seed starts with rank one, and what reaches a host without links ends there,
so ranks are no distribution; both kinds are measured alike. Host verdicts are joined to pages by broadcast while there are at most ``broadcast_hosts``, else
by a join salted over the hot hosts' pages.

Null urls, and urls without ``://``, have an empty host and path; an empty host has no rule, no links and no
rank, so it is allowed. Null html has no links. Links without a host of their own stay within theirs and are
left out. Repeated pages each get their row and weigh as often. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import Scratch, cut

#: (verdict, host, path). A rule covers its host and all subdomains, where the url's path starts with its path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
DAMPING, TOLERANCE, THRESHOLD, BROADCAST_HOSTS, SALTS = 0.85, 1e-6, 0.05, 100_000, 32
#: Rounds of the SQL, which can't test for convergence; a seed's rank is then off by 0.85**120, or 3e-9, at most.
SQL_ROUNDS = 120
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that covers host and path, else null. For lists of up to some hundred rules."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, name, start in reversed(ordered):
        covers = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(covers, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts."""
    urls = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    absolute = F.transform(urls, lambda u: F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u))
    rows = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(absolute).alias("url"))
    rows = rows.select("src", host_of(F.col("url")).alias("dst")).where((F.col("dst") != "") & (F.col("dst") != F.col("src")))
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, every: int = 6) -> DataFrame:
    """Ranks (kind, host, rank). links: kind, src, dst, share (the shares of a source sum to one); seeds: kind, host, seed.

    Rounds go on until all ranks together can't move by more than tolerance any more.
    """
    ranks = seeds.select("kind", "host", F.col("seed").alias("rank"))
    start = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    still = damping**every / (1 - damping**every)  # of the change of these rounds, the most that all later ones can add
    while True:
        before = ranks
        for _ in range(every):
            sent = links.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("rank") * damping).alias("rank"))
            ranks = sent.unionByName(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        ranks = cut(ranks)
        change = ranks.unionByName(before.withColumn("rank", -F.col("rank"))).groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("by"))
        if (change.agg(F.sum("by")).first()[0] or 0.0) * still <= tolerance:
            return ranks


def judge(pages: DataFrame, url: str = "url", html: str = "html", rules: list[tuple[str, str, str]] | None = None, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """Adds host, path, rule, verdict, trust and distrust to pages, in place of columns of those names."""
    scratch = Scratch(pages.sparkSession, "hosts")
    made = ("host", "path", "rule", "verdict", "trust", "distrust")
    plain = [c for c in pages.columns if c not in made]
    split = pages.select(*plain, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = split.withColumn("__rule", rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules))
    by_host = ruled.where("host <> ''").groupBy("host").agg(F.avg(F.coalesce(F.col("__rule.verdict") == "allow", F.lit(False)).cast("double")).alias("allowed"), F.avg(F.coalesce(F.col("__rule.verdict") == "block", F.lit(False)).cast("double")).alias("blocked"))
    hosts = scratch.save(by_host, "hosts")
    seeds = hosts.where("allowed > 0.5").select(F.lit("trust").alias("kind"), "host", F.lit(1.0).alias("seed")).unionByName(hosts.where("blocked > 0.5").select(F.lit("distrust").alias("kind"), "host", F.lit(1.0).alias("seed")))
    found = scratch.save(host_links(split, html), "links")
    both = found.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(found.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    links = scratch.save(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "shares")
    if found.isEmpty():  # no link carries anything: each seed keeps the share that returns to it
        ranks = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    else:
        ranks = propagate(links, seeds, damping, tolerance)
    scored = ranks.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))), F.lit(0.0)).alias("trust"), F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))), F.lit(0.0)).alias("distrust"))
    verdicts = scratch.save(scored.select("host", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust")), "ranks")
    if verdicts.count() <= broadcast_hosts:
        joined = ruled.join(F.broadcast(verdicts), "host", "left")
    else:
        salted = verdicts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
        joined = ruled.withColumn("__salt", F.pmod(F.xxhash64(url), F.lit(SALTS)).cast("int")).join(salted, ["host", "__salt"], "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    own = F.when(distrust - trust >= threshold, "block").otherwise("allow")
    return joined.select(*plain, "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def report(pages: DataFrame, **options) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    return judge(pages.select("page_id", "url", "html"), **options).select("page_id", "host", "path", "rule", "verdict")


def oracle_sql(damping: float = DAMPING, rounds: int = SQL_ROUNDS, threshold: float = THRESHOLD) -> str:
    """The whole method in SQL, a table a round."""
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    lower = f"translate(regexp_extract(%s, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    when = lambda i: " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[i]}'" for v, h, p in rules)
    steps = []
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS (SELECT kind, host, sum(rank) AS rank FROM (SELECT l.kind, l.dst AS host, l.share * r.rank * {damping} AS rank FROM shares l JOIN r{i - 1} r ON l.kind = r.kind AND l.src = r.host UNION ALL SELECT kind, host, seed * {1 - damping} FROM seeds) GROUP BY ALL)")
    return f"""
WITH split AS (SELECT page_id, html, {lower % 'rest'} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
               FROM (SELECT page_id, html, coalesce({rest}, '') AS rest FROM pages)),
ruled AS (SELECT *, CASE {when(0)} END AS rule, CASE {when(1)} END AS ruling FROM split),
hosts AS (SELECT host, avg(CASE WHEN ruling = 'allow' THEN 1.0 ELSE 0 END) AS allowed, avg(CASE WHEN ruling = 'block' THEN 1.0 ELSE 0 END) AS blocked FROM ruled WHERE host <> '' GROUP BY host),
seeds AS (SELECT 'trust' AS kind, host, 1.0::DOUBLE AS seed FROM hosts WHERE allowed > 0.5 UNION ALL SELECT 'distrust', host, 1.0 FROM hosts WHERE blocked > 0.5),
urls AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]+)', 1)) AS url FROM split WHERE host <> ''),
pairs AS (SELECT src, {lower % "substr(url, strpos(url, '//') + 2)"} AS dst FROM urls),
links AS (SELECT src, dst, count(*) AS n FROM pairs WHERE dst <> '' AND dst <> src GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
shares AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_ways),
r0 AS (SELECT kind, host, seed AS rank FROM seeds),
{", ".join(steps)},
scored AS (SELECT host, round(coalesce(sum(rank) FILTER (WHERE kind = 'trust'), 0), 9) AS trust, round(coalesce(sum(rank) FILTER (WHERE kind = 'distrust'), 0), 9) AS distrust FROM r{rounds} GROUP BY host)
SELECT page_id, ruled.host, path, rule, coalesce(ruling, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN scored ON ruled.host = scored.host
"""
