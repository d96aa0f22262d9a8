"""URL filters: host and path rules, and link-graph propagation where no rule fits; DataFrame functions only.

Rules are pairs of host and path: the longest one wins that names the host or a domain above it and begins the path. For
other urls their host decides. Hosts are joined by links (absolute ``href``s, counted) and by their domain (a host and the
host without its first label). Personalised PageRank spreads trust along the links from hosts with allowed pages, and
distrust against the links from hosts with blocked pages. A host is blocked if distrust is above ``limit`` percent of both.

Masses are whole numbers (``UNITS`` in all) and each share is rounded down, so that the sums don't depend on their order.
The walks go on until they have settled, however long the chains of links are.
Pages are counted for each host before anything is joined, so that a host with a third of all pages is one row.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; a null html has no
links; a host without any mass is allowed; repeated rows are judged each; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import if_small, stored

UNITS = 1_000_000_000_000
DAMPING = 0.85
EXACT = 10_000  # the walks end when no mass grows by more than one part in so many
AT_ONCE = 4  # rounds between two written tables
TASK_ROWS = 1_000_000  # hosts or links for a task of a round at least; larger graphs have as many tasks more
LIMIT = 50
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the registered query (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _domains(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules (longest first: path, rule, verdict), for hosts that a rule names."""
    return (hosts.select("host", F.explode(_domains(F.col("host"))).alias("domain")).filter("domain <> ''")
            .join(rules.withColumnRenamed("host", "domain"), "domain")
            .groupBy("host").agg(F.sort_array(F.collect_list(F.struct(
                (-F.length("rule")).alias("order"), "rule", "path", "verdict"))).alias("rules")))


def links(pages: DataFrame) -> DataFrame:
    """src, dst, weight: absolute links from host to other host."""
    out = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")),
                                                              F.lit(r"(?i)href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"))).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to"))
    return (out.select(F.col("host").alias("src"), host_of(to).alias("dst")).filter("src <> '' and dst <> '' and src <> dst")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")))


def _domain_links(hosts: DataFrame) -> DataFrame:
    """Links between a host and the host above it, in both directions."""
    up = (hosts.select(F.explode(_domains(F.col("host"))).alias("src")).distinct()
          .withColumn("dst", F.expr("substr(src, instr(src, '.') + 1)"))
          .filter("instr(src, '.') > 0 and instr(dst, '.') > 0"))
    return up.union(up.select("dst", "src")).withColumn("weight", F.lit(1).cast("long"))


def propagate(edges: DataFrame, seeds: DataFrame, exact: int = EXACT) -> DataFrame:
    """host, trust, distrust: what both walks come to. ``seeds``: host, good, bad (numbers of pages).

    The walks start from nothing, so that no mass ever shrinks; they go on until no host is new and no mass grows by
    more than one part in ``exact`` of itself in a round. Both walks of a round are one join: a row of ``moves`` takes
    trust along a link and distrust against it.
    """
    total = seeds.agg(F.sum("good"), F.sum("bad"), F.count(F.lit(1))).first()

    def given(pages: str, all_pages: int | None) -> Column:
        whole = F.floor(F.lit(float(UNITS)) * F.col(pages) / F.lit(max(all_pages or 0, 1)))
        return F.floor(whole * (1 - DAMPING)).cast("long")

    start = seeds.select("host", given("good", total[0]).alias("trust"), given("bad", total[1]).alias("distrust"))
    start = stored(start.coalesce(1 + total[2] // TASK_ROWS), "seeds")
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("into"))
    shares = edges.join(out, "src").join(into, "dst")
    share = lambda of: F.lit(DAMPING) * F.col("weight") / F.col(of)
    none = F.lit(0.0)
    n_links = edges.count()
    moves = stored(
        shares.select("src", "dst", share("out").alias("ahead"), none.alias("against"))
        .union(shares.select("dst", "src", none, share("into")))
        .groupBy("src", "dst").agg(F.max("ahead").alias("ahead"), F.max("against").alias("against"))
        .coalesce(1 + n_links // TASK_ROWS), "moves")
    n_hosts = moves.select("dst").distinct().count() + start.count()

    def onward(rank: DataFrame) -> DataFrame:
        moved = moves.join(if_small(rank.withColumnRenamed("host", "src"), n_hosts), "src").select(
            F.col("dst").alias("host"), F.floor(F.col("trust") * F.col("ahead")).cast("long").alias("trust"),
            F.floor(F.col("distrust") * F.col("against")).cast("long").alias("distrust"))
        return (start.union(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
                .coalesce(1 + n_hosts // TASK_ROWS))

    rank = start
    while True:
        before = rank
        for _ in range(AT_ONCE - 1):
            before = onward(before)
        # the last round and what it started from are compared, so both are written as one table
        last = onward(before)
        both = stored(last.join(before.select("host", F.col("trust").alias("old_trust"), F.col("distrust").alias("old_distrust")),
                                "host", "left"), "rank")
        grows = lambda mass: (F.col(mass) - F.coalesce(f"old_{mass}", F.lit(0))) * exact > F.col(mass)
        rank = both.select("host", "trust", "distrust")
        if both.filter(grows("trust") | grows("distrust")).isEmpty():
            return rank


def judge(pages: DataFrame, rules: DataFrame, exact: int = EXACT, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, for each row of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rules = rules.withColumn("rule", F.concat(F.lower("host"), "path"))
    hosts = stored(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    known = stored(rules_of_hosts(hosts, rules), "host-rules")
    n_hosts = hosts.count()
    decided = (rows.drop("html").join(if_small(known, n_hosts), "host", "left")
               .withColumn("won", F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), F.lit(0)))
               .select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.col("won.verdict").alias("by_rule")))
    seeds = decided.filter("by_rule is not null").groupBy("host").agg(
        F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad"))
    edges = stored(links(rows).union(_domain_links(hosts)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "edges")
    rank = propagate(edges, seeds, exact)
    scores = hosts.select("host").join(rank, "host", "left").select(
        "host", F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
    bad = F.col("distrust") * (100 - limit) > F.col("trust") * limit
    return (decided.join(if_small(scores, n_hosts), "host")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("by_rule", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust"))
