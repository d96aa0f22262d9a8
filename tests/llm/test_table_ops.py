"""Decontamination, line dedup, URL filter, sharding, top-k and mixing against brute force, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import difference, duck
from ledgerloom.llm import decontaminate, linededup, mixing, sharding, topk, urlfilter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_leaks(spark, make):
    item = "If Anna buys 12 apples for 3 dollars each and sells 5 of them to Bert then how much money does Anna spend in total"
    other = item.replace("12", "40").replace("3 dollars", "7 dollars").replace("Anna", "Carla").replace("5 of", "9 of")
    clash = other.replace("does Carla", "does Dora")  # one person in the item, two in the document
    plain = "the quick brown fox jumps over the lazy dog while seven cats look on from the garden wall"
    rows = [(1, f"Before that. {item}? After.", "", "", 0), (2, f"Here: {other}.", "", "", 0), (3, f"Here: {clash}.", "", "", 0),
            (4, plain.upper(), "", "", 0), (5, "nothing to see here at all in this text", "", "", 0), (6, None, "", "", 0), (7, "", "", "", 0),
            (8, "filler words " * 20000 + plain + " more" * 20000, "", "", 0), (9, " ".join(plain.split()[:10]), "", "", 0),
            (1, f"Before that. {item}? After.", "", "", 0), (None, plain, "", "", 0)]
    docs = make(rows, DOCS)
    bench = spark.createDataFrame([(1, item), (2, plain), (3, None), (4, "too short"), (5, "")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.verbatim) for r in decontaminate.leaks(docs, bench).collect())
    assert got == {(1, 1, True): 2, (2, 1, False): 1, (4, 2, True): 1, (8, 2, True): 1, (None, 2, True): 1}
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 9]
    assert decontaminate.leaks(make([], DOCS), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_align_at_every_place(spark, make):
    """Items that repeat a window, a similar passage before or after the copy, a copy in two parts, and contradictions."""
    row = "What comes next in the sequence 2 4 8 16 32 64 128"
    item = ("A train leaves the northern station at 9 and covers 60 miles before it stops for 5 minutes at the old bridge where "
            "12 people get on and 4 people leave so how many of them are left when it arrives at the harbour at 11")
    renamed = item.replace("at 9", "at 7").replace("60", "85").replace("12", "31").replace("at 11", "at 10")
    false = " ".join(item.replace("60", "70").replace("12", "15").replace("at 9", "at 3").split()[:24])
    parts = " ".join(renamed.split()[:20]) + " we think " + " ".join(renamed.split()[20:])
    sums = "Add up the numbers in this row 3 3 5 5 7 7"
    rows = [(1, f"So. {row}? Yes.", "", "", 0), (2, row.replace("8 16", "9 27"), "", "", 0), (3, f"{false}. No: {renamed}?", "", "", 0),
            (4, f"{renamed}. And {false}", "", "", 0), (5, f"{false}. {parts}.", "", "", 0), (6, sums.replace("3 3 5 5", "4 6 5 5"), "", "", 0),
            (7, f"{false}.", "", "", 0), (8, f"{renamed}. No: {item}.", "", "", 0), (9, "1 2 3 4 5 6 7 8 9 " * 400, "", "", 0),
            (10, item.replace("12 people", "12 men").replace("4 people", "9 men"), "", "", 0), (11, sums.replace("3 3 5 5", "4 4 6 6"), "", "", 0)]
    bench = spark.createDataFrame([(1, row), (2, item), (3, sums)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_matched, r.verbatim) for r in decontaminate.leaks(make(rows, DOCS), bench).collect()}
    n = len(item.split()) - 4
    assert got == {(1, 1): (9, 9, True), (2, 1): (9, 9, False), (3, 2): (n, n, False), (4, 2): (n, n, False), (5, 2): (n, n - 4, False),
                   (8, 2): (n, n, True), (11, 3): (9, 9, False)}


def test_leaks_find_all_verbatim_items(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    texts = {r.doc_id: plain(r.text) for r in docs.collect()}
    want = {(d, r.item_id) for r in bench.collect() for d, t in texts.items() if plain(r.text) in t}
    assert want and {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == want


def test_line_dedup(spark, make):
    got = linededup.without_boilerplate(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "n_lines", "n_dropped", "text")
    assert difference(got, duck(SF), linededup.SQL) is None
    rows = [(i, f"menu\nbody {i}\n\n menu ", "en", "a", 1) for i in range(5)] + [(9, None, "en", "a", 0), (10, "", "en", None, 0), (11, "menu", "", "b", 0)]
    out = linededup.without_boilerplate(make(rows, DOCS))
    by = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.collect()}
    assert by[0] == (4, 2, "body 0\n") and by[9] == (0, 0, None) and by[10] == (1, 0, "") and by[11] == (1, 0, "menu")
    assert linededup.without_boilerplate(make([], DOCS)).count() == 0


def rank_by_hand(edges, seeds):
    """Trust and distrust of each host by solving the linear systems of both walks."""
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    links = np.zeros((len(hosts), len(hosts)))
    for (s, t), w in edges.items():
        links[at[s], at[t]] = w

    def walk(steps, given):
        out = steps.sum(axis=1, keepdims=True)
        share = np.divide(steps, out, out=np.zeros_like(steps), where=out > 0)
        begin = np.array([seeds.get(h, (0, 0))[given] for h in hosts], dtype=float)
        begin *= urlfilter.UNITS * (1 - urlfilter.DAMPING) / max(begin.sum(), 1)
        return np.linalg.solve(np.eye(len(hosts)) - urlfilter.DAMPING * share.T, begin)

    return dict(zip(hosts, zip(walk(links, 0), walk(links.T, 1))))


def near(got, want):
    return want * (1 - 20 / urlfilter.EXACT) - 100 <= got <= want + 1


def test_url_filter(spark):
    link = lambda *urls: "".join(f'<a href="{u}">x</a>' for u in urls)
    pages = [(1, "https://Good.example.net/en/1?x#y", link("http://mid.org/a", "/rel")), (2, "http://bad.net", None), (3, "http://bad.net/x", ""),
             (4, "http://mid.org/de/1", link("http://far.info/", "http://far.info/2")), (5, "http://far.info/", ""), (6, "http://evil.info/p", link("http://bad.net/x")),
             (7, None, link("http://far.info/")), (8, "no host", ""), (9, "https://a.example.com/de/", ""), (10, "http://x.org/fr/#f", ""),
             (3, "http://bad.net/x", ""), (None, "http://far.info/?q", "")]
    rules = spark.createDataFrame(list(urlfilter.RULES), "verdict string, host string, path string")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    got = urlfilter.judge(df, rules).collect()
    assert len(got) == len(pages)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[1] == ("good.example.net", "/en/1", "example.net/en/", "allow") and by[2] == ("bad.net", "", None, "block")
    assert by[3] == ("bad.net", "/x", "net/", "block") and by[9][2:] == ("example.com/de/", "block") and by[10][2:] == ("org/fr/", "allow")
    assert by[4][3] == by[5][3] == "allow" and by[6] == ("evil.info", "/p", None, "block") and by[7] == by[8] == ("", "", None, "allow")
    hosts = {"good.example.net", "bad.net", "mid.org", "far.info", "evil.info", "a.example.com", "x.org"}
    edges = Counter({("good.example.net", "mid.org"): 1, ("mid.org", "far.info"): 2, ("evil.info", "bad.net"): 1})
    for h in hosts:
        while h.count(".") > 1:
            up = h.split(".", 1)[1]
            edges[h, up] += 1
            edges[up, h] += 1
            h = up
    want = rank_by_hand(edges, {"good.example.net": (1, 0), "bad.net": (0, 2), "a.example.com": (0, 1), "x.org": (1, 0)})
    assert all(near(r.trust, want.get(r.host, (0, 0))[0]) and near(r.distrust, want.get(r.host, (0, 0))[1]) for r in got)
    assert urlfilter.judge(df.limit(0), rules).count() == 0


def test_url_filter_follows_long_chains(spark):
    """Twelve hosts, each linking to the next, lead to a blocked one: all are blocked, and a chain to an allowed one isn't."""
    link = lambda host: f'<a href="http://{host}/">x</a>'
    chain = [(i, f"http://h{i}.info/", link(f"h{i + 1}.info" if i < 12 else "bad.net")) for i in range(13)]
    clean = [(100 + i, f"http://c{i}.dev/", link(f"c{i + 1}.dev")) for i in range(13)]
    pages = chain + clean + [(50, "http://bad.net/", None), (51, "http://x.org/fr/", link("c0.dev"))]
    rules = spark.createDataFrame(list(urlfilter.RULES), "verdict string, host string, path string")
    got = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == {50, *range(13)}
    edges = Counter({**{(f"h{i}.info", f"h{i + 1}.info" if i < 12 else "bad.net"): 1 for i in range(13)},
                     **{(f"c{i}.dev", f"c{i + 1}.dev"): 1 for i in range(13)}, ("x.org", "c0.dev"): 1})
    want = rank_by_hand(edges, {"bad.net": (0, 1), "x.org": (1, 0)})
    assert all(near(r.trust, want[r.host][0]) and near(r.distrust, want[r.host][1]) for r in got)


def plain_best_fit(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        fit = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fit:
            _, i = min(fit)
        else:
            i = len(rooms)
            rooms.append(capacity)
        rooms[i] -= s
        out.append((s, i))
    return out


def test_best_fit_on_counts_is_best_fit():
    rng = random.Random(1)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 60) for _ in range(rng.randint(1, 200))), reverse=True)
        runs = sharding.best_fit(sorted(Counter(sizes).items(), reverse=True), 100)
        loads, plain = Counter(), Counter()
        for s, c, b in runs:
            loads[b] += s * c
        for s, b in plain_best_fit(sizes, 100):
            plain[b] += s
        assert sorted(loads.values()) == sorted(plain.values())


def test_sharding(spark, make):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 300) + str(i % 400), "en", "s", 1) for i in range(1500)] + [(i, "copy", "", "", 0) for i in range(2000, 2100)]
    rows += [(None, None, None, None, None), (None, "", "", "", 0), (3000, "é" * 500, "", "", 0), (3000, "é" * 500, "", "", 0)]
    got = sharding.assign(make(rows, DOCS), 8).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    shard_of, load, slots = defaultdict(set), Counter(), defaultdict(list)
    text = defaultdict(set)
    for d, t, *_ in rows:
        text[d].add(t or "")
    for r in got:
        match = [t for t in text[r.doc_id] if zlib.crc32(t.encode()) == r.text_crc32]
        assert match and r.size == len(match[0].encode()) + 16 and r.grown_shard is None
        shard_of[match[0]].add(r.shard)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in shard_of.values()) and set(load) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(load.values()) < 1.03 * min(load.values())
    again = sharding.assign(make(rows, DOCS), 8).collect()
    assert Counter(again) == Counter(got) and sharding.assign(make([], DOCS)).count() == 0


def test_a_large_group_has_its_own_shard(spark):
    runs = sharding.pack([(1000, 1), (10, 100), (7, 30)], 4)
    load = Counter()
    for s, c, b in runs:
        load[b] += s * c
    assert load[0] == 1000 and max(load[b] for b in (1, 2, 3)) - min(load[b] for b in (1, 2, 3)) <= 20


def test_top_k(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = topk.top_k(topk.whole_vectors(table), F.col("vec_id") % 50 == 0)
    assert difference(got, duck(SF), topk.SQL) is None
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.25, -1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]),
            (7, [-1e-30, 0.0]), (0, [1.0, 0.5]), (50, [1e12, 0.0]), (8, [1.0, 0.5]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    old = topk.TILE, topk.SHARD
    topk.TILE, topk.SHARD = 1, 2
    try:
        got = topk.top_k(topk.whole_vectors(df), F.col("vec_id") % 50 == 0, 3).orderBy("query_id", "rank").collect()
    finally:
        topk.TILE, topk.SHARD = old
    v = {0: [256, 128], 1: [256, 128], 2: [64, -256], 7: [-1, 0], 50: [256 * 10 ** 12, 0], 8: [256, 128], 9: [0, 0]}
    want = [(q, i + 1, c, s) for q in (0, 50) for i, (s, c) in enumerate(sorted(
        ((sum(x * y for x, y in zip(v[q], v[c])), c) for c in v if c != q), key=lambda p: (-p[0], p[1]))[:3])]
    assert [tuple(r) for r in got] == want
    assert topk.top_k(topk.whole_vectors(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_large_products_are_exact():
    q = np.array([[2.0 ** 40, 3.0]])
    assert topk.scores(q, np.array([[2.0 ** 20, 1.0]])).tolist() == [[2 ** 60 + 3]]
    assert topk.scores(q, np.array([[2.0 ** 50, 1.0]])).tolist() == [[(1 << 63) - 1]]


def targets_by_hand(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda x: (x is None, (x or "").encode())))}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in sizes}
        capped |= over


def test_mixing(spark, make):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 80)), "en", rng.choice(["a", "b", "B", "é", None, "a", "a"]), 1) for i in range(3000)]
    rows += [(9000, "w w w", "en", "tiny", 1), (9001, None, "en", "a", 0), (9002, "", "en", "none", 0), (None, "w w", "en", "b", 1)] + rows[:5]
    df = make(rows, DOCS)
    got = mixing.copies(df).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for d, t, _, s, _n in rows:
        sizes[s] += len((t or "").split())
    for r in got:
        assert r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    want = targets_by_hand(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= max(0.03 * want[s], 100)
    assert Counter(mixing.copies(df).collect()) == Counter(got)
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixing.copies(make([], DOCS)).count() == 0 and mixing.mix(make([], DOCS)).count() == 0


def test_pivotal_rounding_keeps_sums_and_probabilities(spark):
    one = mixing.ONE
    units = spark.range(4000).select(F.struct(F.col("id").alias("id")).alias("key"), F.lit("s").alias("source"),
                                     F.lit(5).cast("long").alias("size"), (F.lit(one) * ((F.col("id") % 4) + 1) / 8).cast("long").alias("p"))
    got = mixing.round_pivotal(units).collect()
    assert len(got) == 4000 and sum(r.extra for r in got) == 1250  # the sum of the probabilities
    by = Counter(r.key.id % 4 for r in got if r.extra)
    assert all(abs(by[i] - 125 * (i + 1)) < 75 for i in range(4))


def test_lines_of_a_licence_and_long_passages_go_from_small_and_hot_sources(spark):
    """On 0.8 % of the pages a licence line goes, on 0.1 % a passage of 60 words; ordinary lines on as few pages stay."""
    passage = " ".join(f"word{i}" for i in range(60))
    rows = []
    for source, pages in (("hot", 8000), ("small", 500)):
        for i in range(pages):
            lines = [f"own line {source} {i}", f"said {source} {i % (pages // 2)}"]
            lines += ["Licensed under some licence"] * (i % 125 == 0) + [passage] * (i < max(pages // 800, 3)) + ["short and rare"] * (i < pages // 250)
            rows.append((i, "\n".join(lines), "en", source, 1))
    got = linededup.without_boilerplate(spark.createDataFrame(rows, DOCS))
    left = {r.source: (r.a, r.b, r.c, r.d) for r in got.groupBy("source").agg(
        F.count_if(F.col("text").contains("Licensed")).alias("a"), F.count_if(F.col("text").contains("word59")).alias("b"),
        F.count_if(F.col("text").contains("own line")).alias("c"), F.count_if(F.col("text").contains("short and rare")).alias("d")).collect()}
    assert left == {"hot": (0, 0, 8000, 32), "small": (0, 0, 500, 2)}


def test_columns_of_any_name_are_kept(spark):
    names = ["dropped", "n_lines", "n_dropped", "__kept", "__host", "own", "lines", "host", "kept", "__size", "__copies", "__id", "__source",
             "words", "copy", "row", "__row", "a.b"]
    docs = spark.createDataFrame([(i, "menu\nbody", "en", "a", 1) for i in range(6)], DOCS)
    for name in names:
        docs = docs.withColumn(name, F.lit("mine"))
    lines = linededup.without_boilerplate(docs)
    assert lines.count() == 6 and set(lines.columns) == set(docs.columns)
    assert all(r["dropped"] == r["__kept"] == r["own"] == r["a.b"] == "mine" and r["n_dropped"] == 2 for r in lines.collect())
    item = spark.createDataFrame([(1, "some other words that are nowhere in these documents")], "item_id long, text string")
    for out in (mixing.mix(docs), decontaminate.without_leaks(docs, item)):
        assert out.columns == docs.columns
        assert all(r[name] == "mine" for r in out.collect() for name in names)
