import duckdb
from pyspark.sql import functions as F

from ratelens.llm import url_filter

SCHEMA = "page_id long, url string, html string"


#: Rounds are short jobs here, so the tests stop earlier than the query does.
COARSE = 1e-2


def link(*hosts):
    return "<a  href = 'https://%s/x'>t</a>" * len(hosts) % hosts if hosts else "<a href=\"/own\">t</a>"


def pages():
    rows = [
        (1, "http://A.Example.NET/en/1?x#y", link("good.example.org", "m.org")), (2, "https://b.net", None), (3, "https://b.net/x", link("bad.example.com")),
        (4, "http://www.example.com/de/9", link()), (5, "http://www.example.com/fr/9", link("b.net")), (6, "HTTP://good.example.org/fr/", link("m.org", "m.org")),
        (7, "http://m.org", ""), (8, None, None), (9, "no scheme/x", "x"), (10, "http://notexample.net", link("M.ORG")), (11, "http://hub.info/", link("b.net", "c.net")),
        (12, "http://c.net/", link()), (13, "http://hub.info/2", link("b.net")), (14, "://", ""), (15, "http://x.info?q=http://y/z", ""), (16, "http://frorg/fr/", ""),
    ]
    return rows + [(20 + i, "http://c.net/", link("hub.info")) for i in range(30)]


def judged(spark, rows):
    return {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, SCHEMA).coalesce(1), still=COARSE).collect()}


def test_hosts_paths_and_rules(spark):
    found = judged(spark, pages())
    view = {k: (r["host"], r["path"], r["rule"]) for k, r in found.items()}
    assert view[1] == ("a.example.net", "/en/1", "example.net/en/")
    assert view[2] == ("b.net", "", None) and view[3] == ("b.net", "/x", "net/")
    assert view[4] == ("www.example.com", "/de/9", "example.com/de/") and view[5][2] is None
    assert view[6] == ("good.example.org", "/fr/", "org/fr/")
    assert view[8] == ("", "", None) and view[9] == ("", "", None) and view[14] == ("", "", None)
    assert view[10] == ("notexample.net", "", None) and view[15] == ("x.info", "", None) and view[16][2] is None
    assert found[3]["verdict"] == "block" and found[6]["verdict"] == "allow" and found[8]["verdict"] == "allow"


def propagate(seeds, edges, rounds=400, a=url_filter.DAMPING):
    out, into, hosts = {}, {}, set(seeds)
    for (s, d), n in edges.items():
        out[s], into[d] = out.get(s, 0) + n, into.get(d, 0) + n
        hosts |= {s, d}
    rank = {h: seeds.get(h, (0, 0)) for h in hosts}
    for _ in range(rounds):
        new = {}
        for h in hosts:
            t = sum(rank[s][0] * n / out[s] for (s, d), n in edges.items() if d == h) + (0 if h in out else rank[h][0])
            b = sum(rank[d][1] * n / into[d] for (s, d), n in edges.items() if s == h) + (0 if h in into else rank[h][1])
            x, y = seeds.get(h, (0, 0))
            new[h] = ((1 - a) * x + a * t, (1 - a) * y + a * b)
        rank = new
    return rank


def test_trust_equals_brute_force(spark):
    found = judged(spark, pages())
    own, edges = {}, {}
    for r in found.values():
        if r["host"]:
            own.setdefault(r["host"], []).append(r["verdict"] if r["rule"] else None)
    hosts = {k: r["host"] for k, r in found.items()}
    for key, _, html in pages():
        for part in (html or "").split("https://")[1:]:
            to = part.split("/")[0].lower()
            if hosts[key] and to != hosts[key]:
                edges[hosts[key], to] = edges.get((hosts[key], to), 0) + 1
    seeds = {h: (v.count("allow") / len(v), v.count("block") / len(v)) for h, v in own.items()}
    rank = propagate(seeds, edges)
    for r in found.values():
        if r["host"]:
            assert abs(r["trust"] - rank[r["host"]][0]) < 10 * COARSE and abs(r["distrust"] - rank[r["host"]][1]) < 10 * COARSE
            if not r["rule"]:
                assert r["verdict"] == ("block" if rank[r["host"]][1] - rank[r["host"]][0] >= 0.5 else "allow")
    assert any(not r["rule"] and r["verdict"] == "block" for r in found.values())


def test_trust_travels_until_nothing_changes(spark):
    # A chain of 18 links, farther than any fixed few rounds reach; the end keeps what it gets.
    links = {(f"h{i}", f"h{i + 1}"): 1 for i in range(18)}
    seeds = spark.createDataFrame([("h0", 1.0, 0.0)], "host string, trust double, distrust double").coalesce(1)
    edges = spark.createDataFrame([(*k, n) for k, n in links.items()], "src string, dst string, n long").coalesce(1)
    found = {r["host"]: r["trust"] for r in url_filter.spread_trust(seeds, edges, still=1e-3).collect()}
    want = propagate({"h0": (1, 0)}, links)
    assert found["h17"] > 0 and all(abs(found[h] - want[h][0]) < 1e-2 for h in want)


def test_equals_its_sql(spark):
    import pandas as pd

    con = duckdb.connect()
    con.register("pages_frame", pd.DataFrame(pages(), columns=["page_id", "url", "html"]))
    con.execute("CREATE VIEW pages AS SELECT CAST(page_id AS BIGINT) AS page_id, CAST(url AS VARCHAR) AS url, CAST(html AS VARCHAR) AS html FROM pages_frame")
    expected = sorted(con.execute("SELECT page_id, host, path, rule, verdict FROM (" + url_filter.oracle_sql() + ")").fetchall(), key=repr)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judged(spark, pages()).values()), key=repr) == expected


def test_clashing_columns_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame(pages() + [pages()[0]], SCHEMA).selectExpr("*", "'x' AS Host", "1 AS trust", "2 AS rank_host", "3 AS src")
    out = url_filter.judge_urls(docs, still=COARSE)
    assert out.count() == len(pages()) + 1 and [c.lower() for c in out.columns].count("host") == 1
    assert url_filter.judge_urls(docs.where(F.lit(False))).count() == 0
