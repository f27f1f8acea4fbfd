"""URL filter by propagation over the host graph.

Nodes are hosts of page URLs and of absolute links in their HTML. An edge a -> b weighs the number of pages of a that link to b; relative links and links to
the own host make no edge. A host with a common prefix label (www, m, blog, ...) and its site, the host without it, have edges of weight 1 both ways.

Trust is PageRank personalised to trusted sites: mass starts there, follows edges in proportion to their weights with probability ``DAMPING`` and else restarts; mass at hosts without an edge to
follow restarts too. That only multiplies the restarts, so the fixed point is the one without, rescaled to the mass of the seeds: one sum at the end does it. A rank is stated in units of an equal share of a seed.

Distrust starts at blocked sites, where it is 1, and runs over reversed edges: a host's distrust is ``DAMPING`` times the mean distrust of the hosts it links to, weighted by its own links.
So it is the damped share of a host's paths that end at a blocked site, however many other hosts link to that site.

A seed is a site one of whose labels is in the list; for distrust, so is every prefixed host of it. A host is rejected where its distrust is at least ``MIN_DISTRUST`` (somewhat more than a third of its links lead to blocked sites) and above its trust.

The number of steps is fixed, which makes the ranks a finite expression that SQL states too; each step is one join and one aggregation by host.

Defined cases: a page whose URL is null or has no host has null host and ranks and is kept; null HTML has no links; hosts are lower-cased and lose user names and ports; repeated pages
count once for each page_id and url; without seeds all ranks are 0 and all pages are kept; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm._spark import cut

PREFIXES = ("www", "m", "blog", "amp", "mobile")
DAMPING, STEPS, MIN_DISTRUST = 0.85, 12, 0.3
_HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@\s]+)"
_LINK = r"<[aA]\s[^>]*?[hH][rR][eE][fF]\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """The host of an absolute or protocol-relative URL, else null."""
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def _seed(host: Column, labels: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(host, r"\."), F.array(*[F.lit(x) for x in labels])) if labels else F.lit(False)


def host_edges(pages: DataFrame, prefixes: tuple[str, ...] = PREFIXES) -> DataFrame:
    """(src, dst, weight)."""
    seen = pages.select("page_id", host_of(F.col("url")).alias("src"), F.col("url"), F.col("html")).where("src is not null")
    links = seen.select("page_id", "url", "src", F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("href")).select("page_id", "url", "src", host_of(F.col("href")).alias("dst"))
    cross = links.where("dst is not null and dst <> src").distinct().groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = seen.select("src").unionByName(cross.select(F.col("dst").alias("src"))).distinct()
    first = F.substring_index("src", ".", 1)
    site = F.expr("substring(src, length(substring_index(src, '.', 1)) + 2)")
    pairs = hosts.where(first.isin(*prefixes) & site.contains(".")).select("src", site.alias("dst"))
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return cross.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def host_ranks(pages: DataFrame, trusted: tuple[str, ...], blocked: tuple[str, ...], damping: float = DAMPING, steps: int = STEPS, prefixes: tuple[str, ...] = PREFIXES) -> DataFrame:
    """(host, trust, distrust) of every host."""
    # the only pass over HTML
    edges = cut(host_edges(pages, prefixes))
    out_sum = edges.groupBy("src").agg(F.sum("weight").alias("o"))
    shares = edges.join(out_sum, "src").select("src", "dst", (F.col("weight") / F.col("o") * damping).alias("share"))
    # trust flows from src to dst, distrust from dst to src
    zero = F.lit(0.0)
    flows = shares.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.col("share").alias("wt"), zero.alias("wd")).unionByName(shares.select(F.col("dst").alias("host"), F.col("src").alias("to"), zero.alias("wt"), F.col("share").alias("wd")))
    flows = cut(flows.groupBy("host", "to").agg(F.sum("wt").alias("wt"), F.sum("wd").alias("wd")))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").unionByName(flows.select("host")).distinct()
    bare = ~F.substring_index("host", ".", 1).isin(*prefixes)
    named = cut(hosts.select("host", F.when(bare & _seed(F.col("host"), trusted), 1.0).otherwise(0.0).alias("t"), F.when(_seed(F.col("host"), blocked), 1.0).otherwise(0.0).alias("d")))
    base = named.select("host", (F.col("t") * (1 - damping)).alias("t"), zero.alias("d"), F.col("d").alias("b"))
    state = named
    for step in range(steps):
        moved = state.join(flows, "host").select(F.col("to").alias("host"), (F.col("t") * F.col("wt")).alias("t"), (F.col("d") * F.col("wd")).alias("d"), zero.alias("b"))
        state = moved.unionByName(base).groupBy("host").agg(F.sum("t").alias("t"), F.greatest(F.sum("d"), F.max("b")).alias("d"))
        if step % 4 == 3 or step + 1 == steps:
            state = cut(state)
    mass = state.agg(F.sum("t")).first()[0] or 0.0
    seeds = named.agg(F.sum("t")).first()[0] or 0.0
    scale = seeds / mass if mass else 0.0
    return state.select("host", F.round(F.col("t") * scale, 9).alias("trust"), F.round("d", 9).alias("distrust"))


def filter_urls(pages: DataFrame, trusted: tuple[str, ...], blocked: tuple[str, ...], min_distrust: float = MIN_DISTRUST, **how) -> DataFrame:
    """(page_id, host, trust, distrust, keep) of every page."""
    ranks = host_ranks(pages, trusted, blocked, **how)
    seen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", host_of(F.col("url")).alias("host")).distinct()
    reject = (F.col("distrust") >= min_distrust) & (F.col("distrust") > F.col("trust"))
    return seen.join(ranks, "host", "left").select("page_id", "host", "trust", "distrust", F.coalesce(~reject, F.lit(True)).alias("keep"))


def sql(trusted: tuple[str, ...], blocked: tuple[str, ...], damping: float = DAMPING, steps: int = STEPS, prefixes: tuple[str, ...] = PREFIXES, min_distrust: float = MIN_DISTRUST) -> str:
    """The rows of filter_urls() in DuckDB."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    items = lambda xs: "[" + ", ".join(map(quote, xs)) + "]"
    host = lambda c: f"nullif(lower(regexp_extract({c}, {quote(_HOST)}, 1)), '')"
    parts = [
        f"seen AS MATERIALIZED (SELECT DISTINCT page_id, url, html, {host('url')} AS src FROM pages)",
        f"linked AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT DISTINCT page_id, url, src, {host('href')} AS dst FROM (SELECT page_id, url, src, unnest(regexp_extract_all(html, {quote(_LINK)}, 1)) AS href FROM seen WHERE src IS NOT NULL)) WHERE dst IS NOT NULL AND dst <> src GROUP BY src, dst)",
        "named AS (SELECT src FROM seen WHERE src IS NOT NULL UNION SELECT dst FROM linked)",
        f"sites AS (SELECT src, substring(src, strpos(src, '.') + 1) AS dst FROM named WHERE list_contains({items(prefixes)}, split_part(src, '.', 1)) AND strpos(substring(src, strpos(src, '.') + 1), '.') > 0)",
        "edges AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM linked UNION ALL SELECT src, dst, 1.0 FROM sites UNION ALL SELECT dst, src, 1.0 FROM sites) GROUP BY src, dst)",
        "shares AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges)",
        "hosts AS (SELECT src AS host FROM seen WHERE src IS NOT NULL UNION SELECT src FROM shares UNION SELECT dst FROM shares)",
        f"r0 AS MATERIALIZED (SELECT host, (NOT list_contains({items(prefixes)}, split_part(host, '.', 1)) AND list_has_any(string_split(host, '.'), {items(trusted)}))::INT::DOUBLE AS t, list_has_any(string_split(host, '.'), {items(blocked)})::INT::DOUBLE AS d FROM hosts)",
    ]
    for i in range(steps):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT host, sum(t) AS t, greatest(sum(d), max(b)) AS d FROM (SELECT dst AS host, {damping} * t * share AS t, 0.0 AS d, 0.0 AS b FROM shares JOIN r{i} ON host = src UNION ALL SELECT src, 0.0, {damping} * d * share, 0.0 FROM shares JOIN r{i} ON host = dst UNION ALL SELECT host, {1 - damping} * t, 0.0, d FROM r0) GROUP BY host)")
    parts.append(f"scale AS (SELECT coalesce((SELECT sum(t) FROM r0) / nullif((SELECT sum(t) FROM r{steps}), 0), 0) AS x)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT page_id, src AS host, trust, distrust, coalesce(NOT (distrust >= {min_distrust} AND distrust > trust), true) AS keep
FROM (SELECT DISTINCT page_id, url, src FROM seen) LEFT JOIN (SELECT host, round(t * (SELECT x FROM scale), 9) AS trust, round(d, 9) AS distrust FROM r{steps}) ON host = src"""
