import duckdb

from lexmill.llm.link_trust import filter_urls, host_ranks, sql
from lexmill.llm.queries import BLOCKED, TRUSTED

ROWS = [
    (9001, "http://a.example.com/x", '<p><a href="http://www.spam-farm.example.com/1">x</a> <A HREF=//ththth.example.net/ >y</a>'),
    (9001, "http://a.example.com/x", '<p><a href="http://www.spam-farm.example.com/1">x</a> <A HREF=//ththth.example.net/ >y</a>'),
    (9002, "ftp:/bad", None), (9003, None, '<a href="http://q.org/">'), (None, "http://b.org", ""), (9004, "https://u@Q.org:80/z?", "<a class=k href='http://a.example.com'>"),
]


def compare(pages):
    key = ["page_id", "host", "trust", "distrust", "keep"]
    got = filter_urls(pages, TRUSTED, BLOCKED).toPandas()[key]
    with duckdb.connect() as con:
        con.register("pages", pages.toPandas())
        want = con.execute(sql(TRUSTED, BLOCKED)).df()[key]
    order = lambda df: df.sort_values(key).fillna(-9).reset_index(drop=True)
    assert order(got).astype(str).equals(order(want).astype(str))
    return got


def test_equals_sql_and_propagates(spark, sf):
    extra = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    got = compare(spark.read.parquet(f"{sf}/pages.parquet").unionByName(extra))
    rejected = set(got[~got["keep"]]["host"])
    assert {"a.example.com", "q.org"} <= rejected, "hosts that link to blocked ones, directly or not"
    assert not any(h and h.split(".")[0].startswith("th") for h in rejected)
    assert got[got["host"].isna()]["keep"].all()


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string, host string, t double")
    assert filter_urls(empty, TRUSTED, BLOCKED).collect() == []
    one = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    assert all(r["keep"] for r in filter_urls(one, trusted=(), blocked=()).collect())


def link(page, host, *to):
    return (page, f"http://{host}/{page}", " ".join(f'<a href="http://{x}/">x</a>' for x in to))


def test_distrust_does_not_thin_out_with_the_number_of_links(spark):
    """A blocked site, its www host and n other hosts that link to it: all are rejected, for every n; a host with one link of four to it stays."""
    for n in (1, 300):
        rows = [link(0, "x.spam-farm.net", "x.spam-farm.net"), link(1, "www.x.spam-farm.net", "a.org", "b.org", "c.org")]
        rows += [link(2 + i, f"h{i}.org", "x.spam-farm.net") for i in range(n)] + [link(1000, "mixed.org", "x.spam-farm.net", "a.org", "b.org", "c.org")]
        got = compare(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
        kept = set(got[got["keep"]]["host"])
        assert kept == {"mixed.org"}


def test_trust_has_the_mass_of_the_seeds(spark):
    """Mass at hosts without links restarts at the seeds: after rescaling, trust sums to the number of seeds."""
    rows = [link(0, "ththth.net", "a.org", "b.org"), link(1, "a.org", "c.org"), link(2, "tiontion.net", "b.org"), link(3, "far.org")]
    ranks = {r["host"]: r["trust"] for r in host_ranks(spark.createDataFrame(rows, "page_id bigint, url string, html string"), TRUSTED, BLOCKED, steps=60).collect()}
    assert abs(sum(ranks.values()) - 2) < 1e-6 and ranks["far.org"] == 0
    # by the definition: dangling mass goes to the seeds in equal shares
    hosts = ["ththth.net", "tiontion.net", "a.org", "b.org", "c.org"]
    edges = {"ththth.net": ["a.org", "b.org"], "a.org": ["c.org"], "tiontion.net": ["b.org"]}
    x = dict.fromkeys(hosts, 0.4)
    for _ in range(300):
        lost = sum(x[h] for h in hosts if h not in edges)
        y = {h: (0.15 + 0.85 * lost / 2) * (h in hosts[:2]) for h in hosts}
        for h, to in edges.items():
            for k in to:
                y[k] += 0.85 * x[h] / len(to)
        x = y
    assert all(abs(ranks[h] - x[h]) < 1e-4 for h in hosts)


def test_odd_rows(spark):
    long = '<a href="http://x.spam-farm.net/">x</a>' + "word " * 200_000
    rows = [(1, None, None, "h", 1.0, "s"), (None, None, long, None, None, None), (None, "http://a.org/", None, "h", 2.0, "d"), (2, "http://a.org/", long, "h", 3.0, "w"), (2, "http://a.org/", long, "h", 3.0, "w"), (3, "", "", "h", 3.0, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, weight double, src string")
    got = sorted(map(tuple, filter_urls(pages, TRUSTED, BLOCKED).collect()), key=repr)
    assert [(r[0], r[1], r[4]) for r in got] == [(1, None, True), (2, "a.org", False), (3, None, True), (None, "a.org", False), (None, None, True)]
