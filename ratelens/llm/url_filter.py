"""URL verdicts: prefix rules first, and trust spread over the host graph for what no rule covers.

Hosts seed trust by the share of their pages that a rule allows, and distrust by the share that one blocks. Trust
follows the links between hosts (personalised PageRank); distrust follows them backwards, so a host that links to
blocked ones takes some of theirs. A host whose distrust exceeds its trust by the threshold is blocked.
Everything is made of DataFrame functions; links are counted per pair of hosts before anything is joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import fresh, letters_lowered
from ratelens.session import drop_materialized, materialize

#: The rules as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

DAMPING = 0.85
THRESHOLD = 0.5
#: Rounds end once no host changes by more. All changes together shrink by the damping in each round, so the end always comes.
STILL = 1e-9
#: Rounds after which a change of 1 is below STILL, for the SQL, which cannot stop by itself.
SQL_ROUNDS = math.ceil(math.log(STILL) / math.log(DAMPING))
#: Addresses with a host in `href` attributes; relative links stay on their host and carry nothing.
LINK = r"(?i)href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/\"'?#\s>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A to Z in lower case) and path of a URL; both empty for a null one or one without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0)
    after = F.substring(F.coalesce(rest, F.lit("")), F.length(host) + 1, F.length(F.coalesce(rest, F.lit(""))))
    return letters_lowered(host), F.regexp_extract(after, "^[^?#]*", 0)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none does) and its verdict. A rule fits its host and subdomains, for
    paths that start with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, host: str, html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    linked = pages.where(F.col(html).contains("//") & (F.col(host) != "")).select(
        F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("to")
    )
    named = linked.select("src", letters_lowered(F.col("to")).alias("dst")).where(F.col("src") != F.col("dst"))
    return named.groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread_trust(
    seeds: DataFrame, edges: DataFrame, still: float = STILL, damping: float = DAMPING
) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) and edges (src, dst, n).

    Hosts that only appear in edges have seeds of 0. A host without links out keeps its trust, one without
    links in its distrust. Weights are shares of a host's links. Every round is written to the shared folder;
    rounds go on until no host changes by more than `still`, however long the chains of links are.
    """
    edges = materialize(edges)
    out = edges.groupBy("src").agg(F.sum("n").alias("sent"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("got"))
    shares = materialize(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("sent")).alias("forth"), (F.col("n") / F.col("got")).alias("back")))
    zero = F.lit(0.0)
    ends = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).distinct()
    hosts = ends.join(seeds, "host", "full").join(out.withColumnRenamed("src", "host"), "host", "left").join(into.withColumnRenamed("dst", "host"), "host", "left")
    start = materialize(hosts.select(
        "host", F.coalesce("trust", zero).alias("seed_trust"), F.coalesce("distrust", zero).alias("seed_distrust"),
        F.col("sent").isNull().alias("no_out"), F.col("got").isNull().alias("no_in"),
    ))
    ranks = materialize(start.select("host", F.col("seed_trust").alias("trust"), F.col("seed_distrust").alias("distrust")))
    while True:
        forth = shares.join(ranks, shares["src"] == ranks["host"]).select(F.col("dst").alias("to"), (F.col("trust") * F.col("forth")).alias("t"), zero.alias("d"))
        back = shares.join(ranks, shares["dst"] == ranks["host"]).select(F.col("src").alias("to"), zero.alias("t"), (F.col("distrust") * F.col("back")).alias("d"))
        sums = forth.union(back).groupBy("to").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        met = start.join(ranks, "host").join(sums, F.col("host") == F.col("to"), "left")
        moved = lambda seed, sent, kept, own: (1 - damping) * F.col(seed) + damping * (F.coalesce(sent, zero) + F.when(F.col(kept), F.col(own)).otherwise(0.0))
        trust, distrust = moved("seed_trust", "t", "no_out", "trust"), moved("seed_distrust", "d", "no_in", "distrust")
        change = F.greatest(F.abs(trust - F.col("trust")), F.abs(distrust - F.col("distrust")))
        new = materialize(met.select("host", trust.alias("trust"), distrust.alias("distrust"), change.alias("change")))
        drop_materialized(ranks)
        ranks = new.drop("change")
        if not new.where(F.col("change") > still).head(1):
            return ranks


def judge_urls(
    pages: DataFrame, url: str = "url", html: str = "html", rules=RULES, threshold: float = THRESHOLD, still: float = STILL
) -> DataFrame:
    """All rows and columns but the page itself, plus host, path, rule, verdict, trust and distrust.

    Columns of the new names are replaced. A null URL, or one without `://`, has an empty host and path and is
    allowed unless a rule fits. Pages without a host give and take no trust. A null page has no links.
    Repeated rows count as often as they occur; an empty table gives an empty one.
    """
    new = ("host", "path", "rule", "verdict", "trust", "distrust")
    host, path = host_and_path(F.col(url))
    parsed = pages.select(*[c for c in pages.columns if c.lower() not in new], host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": rule, "verdict": verdict})
    share = lambda kind: F.avg(F.when(F.col("verdict") == kind, 1.0).otherwise(0.0))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    ranks = spread_trust(seeds, host_edges(parsed, "host", html), still)
    (key,) = fresh(ruled, "rank_host")
    met = ruled.join(ranks.withColumnRenamed("host", key), F.col("host") == F.col(key), "left")
    bad = F.coalesce(F.col("distrust") - F.col("trust") >= threshold, F.lit(False))
    final = F.coalesce("verdict", F.when(bad, F.lit("block")).otherwise("allow"))
    kept = [c for c in ruled.columns if c not in ("host", "path", "rule", "verdict", html)]
    return met.select(*kept, "host", "path", "rule", final.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def oracle_sql(rules=RULES, iterations: int = SQL_ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """The same verdicts in DuckDB's SQL, with one pair of tables for each round."""
    fits = lambda text: "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}'))".format(
        text.partition("/")[0], "/" + text.partition("/")[2]
    )
    longest = sorted(rules, key=lambda r: -len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{k}'" for k, t in longest) + " END"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = LINK.replace("'", "''")
    rounds, last = [], "r0"
    for i in range(1, iterations + 1):
        rounds.append(f"""
        s{i} AS MATERIALIZED (
          SELECT h, sum(t) AS t, sum(d) AS d FROM (
            SELECT dst AS h, trust * forth AS t, 0.0 AS d FROM shares JOIN r{i - 1} ON src = host
            UNION ALL SELECT src, 0.0, distrust * back FROM shares JOIN r{i - 1} ON dst = host) GROUP BY h),
        r{i} AS MATERIALIZED (
          SELECT host, {1 - damping} * seed_t + {damping} * (coalesce(t, 0) + CASE WHEN no_out THEN trust ELSE 0 END) AS trust,
                 {1 - damping} * seed_d + {damping} * (coalesce(d, 0) + CASE WHEN no_in THEN distrust ELSE 0 END) AS distrust
          FROM start JOIN r{i - 1} USING (host) LEFT JOIN s{i} ON h = host)""")
        last = f"r{i}"
    return f"""WITH cut AS (
      SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
    parsed AS (SELECT page_id, html, {lower("h")} AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts),
    ruled AS (SELECT *, {rule} AS rule, {verdict} AS own FROM parsed),
    seeds AS (SELECT host, avg(CASE WHEN own = 'allow' THEN 1.0 ELSE 0.0 END) AS seed_t,
                     avg(CASE WHEN own = 'block' THEN 1.0 ELSE 0.0 END) AS seed_d FROM ruled WHERE host <> '' GROUP BY host),
    found AS (SELECT host AS src, {lower("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM parsed WHERE host <> ''),
    edges AS (SELECT src, dst, count(*) AS n FROM found WHERE src <> dst GROUP BY src, dst),
    shares AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forth, n / sum(n) OVER (PARTITION BY dst) AS back FROM edges),
    every AS (SELECT src AS host FROM edges UNION SELECT dst FROM edges UNION SELECT host FROM seeds),
    start AS MATERIALIZED (
      SELECT host, coalesce(seed_t, 0) AS seed_t, coalesce(seed_d, 0) AS seed_d,
             host NOT IN (SELECT src FROM edges) AS no_out, host NOT IN (SELECT dst FROM edges) AS no_in
      FROM every LEFT JOIN seeds USING (host)),
    r0 AS (SELECT host, seed_t AS trust, seed_d AS distrust FROM start),{",".join(rounds)}
    SELECT page_id, host, path, rule,
           coalesce(own, CASE WHEN distrust - trust >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict
    FROM ruled LEFT JOIN {last} USING (host)"""
