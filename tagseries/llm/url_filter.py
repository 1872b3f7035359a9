"""Operator 6, URL filters by link-graph propagation (DataFrame functions only).

Fixed rules judge a url by the longest rule that fits.  Hosts without a rule are judged by the host
graph that the pages' links make: personalised PageRank runs along links from trusted hosts (some page
is allowed by a rule, none is blocked), and the same walk runs along reversed links from blocked hosts
(rules block more than half of the pages), because linking to a blocked host is what earns distrust.  A host whose distrust, less ``threshold`` hundredths of its
trust, is above zero is blocked.  Ranks are integers (a total of 10^12 per walk, integer division),
so the result does not depend on the order of sums.

Links are merged to one row per host pair before any iteration.  Both walks share one table and one
join per iteration; every second iteration is written to the shared folder.

Edge cases: a null url has no host and no path, fits no rule and is allowed unless distrusted; null
html has no links; links of a host to itself do not count; an empty table gives an empty result.  Very
long pages are read whole.  Only the page's id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagseries.llm.common import LOWER, UPPER, lower_ascii, stage, unstage

# Host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MASS, DAMPING, ROUNDS, THRESHOLD = 10**12, 85, 8, 100
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null fields without one."""
    pick = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        pick = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(pick)
    return pick


def judged_pages(pages: DataFrame, id_col="page_id", url_col="url", rules=RULES) -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    df = pages.select(F.col(id_col).alias("id"), lower_ascii(F.regexp_extract(url, URL, 1)).alias("host"),
                      F.regexp_extract(url, URL, 2).alias("path"))
    return df.withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules))


def host_links(pages: DataFrame, url_col="url", html_col="html") -> DataFrame:
    """(src, dst, n): number of links from one host to another."""
    src = lower_ascii(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), URL, 1))
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1))
    df = pages.select(src.alias("src"), F.explode(found).alias("dst")).withColumn("dst", lower_ascii(F.col("dst")))
    return df.where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, rounds=ROUNDS, damping=DAMPING) -> DataFrame:
    """(walk, host, rank) from links (src, dst, n) and seeds (walk, host); walk 0 follows the links,
    walk 1 goes against them."""
    steps = links.select(F.lit(0).alias("walk"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionByName(
        links.select(F.lit(1).alias("walk"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    out = steps.groupBy("walk", "host").agg(F.sum("n").alias("out"))
    steps = stage(steps.join(out, ["walk", "host"]), "steps")
    count = seeds.groupBy("walk").agg(F.count("*").alias("c"))
    seeds = stage(seeds.join(F.broadcast(count), "walk").select("walk", "host", F.expr(f"{MASS} div c").alias("seed")), "seeds")
    rank, kept = seeds.withColumnRenamed("seed", "rank"), None
    for i in range(rounds):
        flow = steps.join(rank, ["walk", "host"]).groupBy("walk", F.col("to").alias("host")).agg(
            F.sum(F.expr("rank * n div out")).alias("flow"))
        rank = flow.select("walk", "host", F.expr(f"flow * {damping} div 100").alias("part")).unionByName(
            seeds.select("walk", "host", F.expr(f"seed * {100 - damping} div 100").alias("part"))).groupBy(
            "walk", "host").agg(F.sum("part").alias("rank"))
        if i % 2 or i == rounds - 1:
            old, kept = kept, stage(rank, "rank")
            rank = kept
            if old is not None:
                unstage(old)
    return rank


def url_filter(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", rules=RULES,
               rounds=ROUNDS, threshold=THRESHOLD) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust, distrust (ranks of its host)."""
    j = judged_pages(pages, id_col, url_col, rules)
    said = lambda v: F.sum((F.col("r.verdict") == v).cast("long"))
    seeds = j.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.coalesce(said("allow"), F.lit(0)).alias("good"),
        F.coalesce(said("block"), F.lit(0)).alias("bad"))
    seeds = seeds.where("2 * bad > n or (good > 0 and bad = 0)").select(
        F.when(F.col("bad") == 0, 0).otherwise(1).alias("walk"), "host")
    rank = propagate(host_links(pages, url_col, html_col), seeds, rounds)
    by_host = rank.groupBy("host").agg(
        F.sum(F.when(F.col("walk") == 0, F.col("rank"))).alias("trust"),
        F.sum(F.when(F.col("walk") == 1, F.col("rank"))).alias("distrust"))
    # a host's rank joins its pages; a host with a third of all pages is split by the skew join
    j = j.join(by_host, "host", "left").na.fill(0, ["trust", "distrust"])
    method = F.when(F.col("distrust") * 100 > F.col("trust") * threshold, "block").otherwise("allow")
    return j.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"),
                    F.coalesce("r.verdict", method).alias("verdict"), "trust", "distrust")


def url_sql() -> str:
    """DuckDB SQL for the same rows over the view ``pages``, the iterations written out."""
    fits = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}'"
                    for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    says = " ".join(f"when '{h}{p}' then '{v}'" for h, p, v in RULES)
    low = f"'{UPPER}', '{LOWER}'"
    link = LINK.replace("'", "''")
    sql = f"""with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), {low}) host,
        regexp_extract(coalesce(url, ''), '{URL}', 2) path, html from pages),
    r as (select *, case {fits} end rule from u), j as (select *, case rule {says} end rv from r),
    l as (select host src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), {low}) dst from u),
    e as (select src, dst, count(*) n from l where src <> dst and src <> '' group by all),
    st as (select 0 walk, src host, dst "to", n from e union all select 1, dst, src, n from e),
    s as (select *, (sum(n) over (partition by walk, host))::bigint "out" from st),
    sd0 as (select case when bad = 0 then 0 else 1 end walk, host from (select host, count(*) n,
            count(*) filter (rv = 'allow') good, count(*) filter (rv = 'block') bad from j where host <> '' group by 1)
            where 2 * bad > n or (good > 0 and bad = 0)),
    sd as (select walk, host, {MASS} // count(*) over (partition by walk) seed from sd0),
    r0 as (select walk, host, seed rank from sd)"""
    for i in range(ROUNDS):
        sql += f""", r{i + 1} as (select walk, host, sum(part)::bigint rank from (
            select walk, "to" host, sum(rank * n // "out")::bigint * {DAMPING} // 100 part from s join r{i} using (walk, host) group by 1, 2
            union all select walk, host, seed * {100 - DAMPING} // 100 from sd) group by 1, 2)"""
    return sql + f""", h as (select host, coalesce(sum(rank) filter (walk = 0), 0)::bigint trust,
        coalesce(sum(rank) filter (walk = 1), 0)::bigint distrust from r{ROUNDS} group by 1)
    select page_id, host, path, rule, coalesce(rv, case when coalesce(distrust, 0) * 100 > coalesce(trust, 0) * {THRESHOLD}
        then 'block' else 'allow' end) verdict, coalesce(trust, 0)::bigint trust, coalesce(distrust, 0)::bigint distrust
    from j left join h using (host)"""
