"""Matching against brute force on small tables."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import matching, posting, reads
from ledgerloom.operators.batchrun import connected, reconcile_in_order
from ledgerloom.operators.subsets import count_subsets, find_subsets, moves_of

POOL = "document_id string, vendor_code string, invoice_number string, supplier_legal_name string, document_date date, net_paise bigint"
CREDITS = "vendor_code string, transaction_id string, utr_number string, transaction_date date, narration string, amount_paise bigint"
SETTLE = ("vendor_code string, payout_id string, reference_id string, utr string, amount_paise bigint, narration string, status string,"
          " fees_paise bigint, tax_paise bigint, ingested_epoch bigint")
DAY = dt.date(2026, 8, 1)


def invoice(i, net, supplier="Acme Tools", day=0, vendor="V"):
    return (f"d{i}", vendor, f"INV-{i:04d}", supplier, DAY + dt.timedelta(days=day), net)


def credit(i, amount, narration="NEFT/1/HDFC/ACME TOOLS", day=0, vendor="V", utr=...):
    return (vendor, f"t{i}", f"u{i}" if utr is ... else utr, DAY + dt.timedelta(days=day), narration, amount)


def sets_by_hand(target, pool):
    """All sets adding up to the target; none goes on after the sum is reached."""
    rows = sorted((net, no) for _, _, no, _, _, net in pool)
    if target == 0:
        return {()}
    found = set()
    for size in range(1, len(rows) + 1):
        for combo in itertools.combinations(rows, size):
            sums = list(itertools.accumulate(net for net, _ in combo))
            if sums[-1] == target and target not in sums[:-1]:
                found.add(tuple(sorted(no for _, no in combo)))
    return found


@pytest.mark.parametrize("seed,low", [(1, 1), (2, 0), (3, -3)])
def test_subsets_of_any_size(spark, seed, low):
    rng = random.Random(seed)
    pool = [invoice(i, rng.randint(low, 9), vendor=f"V{i % 2}") for i in range(16)]
    targets = [(f"V{v}", t) for v in (0, 1) for t in range(0, 20)]
    got = find_subsets(spark.createDataFrame(targets, "vendor_code string, amount_paise bigint"),
                       spark.createDataFrame(pool, POOL), salts=3, cap=None).collect()
    have = {}
    for r in got:
        have.setdefault((r.vendor_code, r.amount_paise), set()).add(tuple(r.members))
    for vendor, target in targets:
        assert have.get((vendor, target), set()) == sets_by_hand(target, [p for p in pool if p[1] == vendor])


def test_subset_cap_keeps_the_first_in_search_order(spark):
    pool = spark.createDataFrame([invoice(i, 1) for i in range(12)], POOL)
    got = find_subsets(spark.createDataFrame([("V", 6)], "vendor_code string, amount_paise bigint"), pool, cap=250).collect()
    want = list(itertools.islice(itertools.combinations([f"INV-{i:04d}" for i in range(12)], 6), 250))
    assert sorted(tuple(r.members) for r in got) == sorted(want)


def decide_one(spark, pool, credits, target=None, utr=None):
    requests = spark.createDataFrame([("V", utr, None if utr else target)], "vendor_code string, request_utr string, request_paise bigint")
    return matching.match_requests(requests, spark.createDataFrame(credits, CREDITS), spark.createDataFrame(pool, POOL)).first()


def test_phases(spark):
    one = decide_one(spark, [invoice(1, 500)], [credit(1, 500)], 500)
    assert (one.subset_status, one.phase, one.matched_utr) == ("SUBSET_MATCHED", 1, "u1")
    two = decide_one(spark, [invoice(1, 500), invoice(2, 500, "Zenith Foods")], [credit(1, 500)], 500)
    assert (two.phase, two.matched_invoices) == (2, ["INV-0001"])
    three = decide_one(spark, [invoice(1, 500, day=-1), invoice(2, 500, day=-5)], [credit(1, 500)], 500)
    assert (three.phase, three.matched_invoices) == (3, ["INV-0001"])
    for pool in ([invoice(1, 500), invoice(2, 500)], [invoice(1, 500, day=-8), invoice(2, 500, day=-9)]):
        assert decide_one(spark, pool, [credit(1, 500)], 500).subset_status == "AMBIGUOUS_COLLISION"
    assert decide_one(spark, [invoice(1, 500)], [credit(1, 400)], 500).subset_status == "NO_MATCH"


def test_date_phase_looks_at_all_options(spark):
    """Two tied names and a nearer date elsewhere: the nearer date wins."""
    pool = [invoice(1, 500, day=-3), invoice(2, 500, day=-3), invoice(3, 500, "Zenith Foods", day=-1)]
    got = decide_one(spark, pool, [credit(1, 500)], 500)
    assert (got.phase, got.matched_invoices) == (3, ["INV-0003"])


def test_utr_request_ignores_the_target(spark):
    got = decide_one(spark, [invoice(1, 300), invoice(2, 200)], [credit(1, 500), credit(2, 200)], 300, utr="u1")
    assert (got.subset_status, got.matched_invoices, got.proof_paise) == ("SUBSET_MATCHED", ["INV-0001", "INV-0002"], 500)


def test_credit_without_utr_is_never_excluded(spark):
    bank = spark.createDataFrame([credit(1, 5, utr=None), credit(2, 5)], CREDITS).withColumn("transaction_type", F.lit("CREDIT"))
    recs = spark.createDataFrame([("V", None), ("V", "u2")], "vendor_code string, utr_number string")
    assert [r.transaction_id for r in reads.unmatched_credits(bank, recs).collect()] == ["t1"]


def by_hand_in_order(pool, credits, anchors):
    """The rule one invoice at a time, with sets of one and two members, and unique options only."""
    open_pool, open_credits, out = list(pool), list(credits), {}
    for inv in pool:
        if inv not in open_pool:
            out[inv[0]] = "ALREADY_COMMITTED"
            continue
        utr = anchors.get(inv[2])
        mine = [c for c in open_credits if (c[2] == utr if utr else c[5] == inv[5])]
        options = [(c, s) for c in mine for s in sets_by_hand(c[5], open_pool)]
        if len(options) == 1 and inv[2] in options[0][1] and options[0][0][2]:
            c, s = options[0]
            out[inv[0]] = "LEDGER_COMMITTED"
            open_credits = [x for x in open_credits if x[2] != c[2]]
            open_pool = [p for p in open_pool if p[2] not in s]
        else:
            out[inv[0]] = "EXCEPTION_ROUTED"
    return out


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_batch_in_order_equals_one_at_a_time(spark, seed):
    """Same names and no dates in reach, so that only the amount phase can decide."""
    rng = random.Random(seed)
    pool = [invoice(i, rng.choice([3, 4, 5, 7, 8, 11, 12]), "Zenith Foods", day=-100) for i in range(9)]
    credits = [credit(i, rng.choice([3, 4, 5, 7, 9, 11, 12, 15])) for i in range(6)]
    anchors = {pool[i][2]: f"u{i}" for i in range(0, 6, 2)}
    settle = [("V", f"p{no}", no, utr, 1, "", "processed", 0, 0, 1) for no, utr in anchors.items()]
    outcomes, posted = reconcile_in_order(
        spark.createDataFrame(pool, POOL).withColumn("run_order", F.col("document_id")), spark.createDataFrame(settle, SETTLE),
        spark.createDataFrame(credits, CREDITS))
    assert {r.document_id: r.terminal for r in outcomes.collect()} == by_hand_in_order(pool, credits, anchors)
    numbers = [r.invoice_number for r in posted.collect()]
    assert len(numbers) == len(set(numbers))


def test_connected(spark):
    edges = [("a", "h1"), ("b", "h1"), ("b", "h2"), ("c", "h2"), ("d", "h3")]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "node string, hub string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_posting_twice_changes_nothing(spark):
    invoices = spark.createDataFrame([invoice(1, 300), invoice(2, 200)], POOL)
    proofs = spark.createDataFrame([("V", "p1", ["INV-0001", "INV-0002"], "u1", 500, "po")],
                                   "vendor_code string, proof_id string, matched_invoices array<string>, matched_utr string,"
                                   " proof_paise bigint, payout_id string")
    none = spark.createDataFrame([], "document_id string")
    posted, status = posting.post_matches(proofs, invoices, none, F.col("proof_id"))
    assert sorted((r.invoice_number, r.net_settled_amount_paise) for r in posted.collect()) == [("INV-0001", 300), ("INV-0002", 200)]
    again, status = posting.post_matches(proofs, invoices, posted, F.col("proof_id"))
    assert again.count() == 0 and status.first().posting_status == "DUPLICATE_EVENT"
    events = posting.parse_completed(posting.completed_events(posted))
    lines = posting.ledger_lines(posting.new_records(events, spark.createDataFrame([], "event_id string")))
    assert lines.count() == 4
    assert lines.selectExpr("sum(CASE entry_type WHEN 'DEBIT' THEN amount_paise ELSE -amount_paise END) AS d").first().d == 0


def test_no_set_is_lost_without_a_cap(spark):
    pool = spark.createDataFrame([invoice(i, 1) for i in range(12)], POOL)
    got = find_subsets(spark.createDataFrame([("V", 6)], "vendor_code string, amount_paise bigint"), pool).collect()
    assert len({tuple(r.members) for r in got}) == len(got) == 924


TARGETS = "vendor_code string, amount_paise bigint"


@pytest.mark.parametrize("seed,low", [(5, 1), (6, 0), (7, -3)])
def test_counts_equal_the_listed_sets(spark, seed, low):
    rng = random.Random(seed)
    pool = [invoice(i, rng.randint(low, 9), vendor=f"V{i % 3}") for i in range(24)]
    targets = spark.createDataFrame([(f"V{v}", t) for v in range(4) for t in range(-2, 25)], TARGETS)
    invoices = spark.createDataFrame(pool, POOL)
    got = {(r.vendor_code, r.amount_paise): int(r.subsets) for r in count_subsets(targets, invoices, salts=2).collect()}
    listed = {}
    for r in find_subsets(targets, invoices).collect():
        listed[r.vendor_code, r.amount_paise] = listed.get((r.vendor_code, r.amount_paise), 0) + 1
    for vendor in range(4):
        for t in range(-2, 25):
            want = len(sets_by_hand(t, [p for p in pool if p[1] == f"V{vendor}"])) if t >= 0 else 0
            assert got.get((f"V{vendor}", t), 0) == listed.get((f"V{vendor}", t), 0) == want


def test_many_equal_nets_are_counted_not_listed(spark):
    pool = spark.createDataFrame([invoice(i, 7) for i in range(40)] + [invoice(90 + i, 1000 + i) for i in range(5)], POOL)
    got = {r.amount_paise: int(r.subsets) for r in count_subsets(spark.createDataFrame(
        [("V", 7 * k) for k in range(42)] + [("V", 1000 + 70), ("V", 2001 + 7), ("V", 5)], TARGETS), pool).collect()}
    assert all(got[7 * k] == math.comb(40, k) for k in range(41)) and 7 * 41 not in got and 5 not in got
    assert got[1070] == math.comb(40, 10) and got[2008] == 40


def test_choices_of_many_equal_nets(spark):
    """Nearly all of many equal nets: beginnings that can't be completed are never made."""
    pool = spark.createDataFrame([invoice(i, 7) for i in range(24)] + [invoice(50, 1), invoice(51, 2)], POOL)
    got = find_subsets(spark.createDataFrame([("V", 7 * 24), ("V", 7 * 23 + 3), ("V", 7 * 22)], TARGETS), pool).collect()
    sizes = sorted((r.amount_paise, r.size) for r in got)
    assert sizes == [(154, 22)] * math.comb(24, 22) + [(164, 25)] * 24 + [(168, 24)]
    assert len({tuple(r.members) for r in got}) == len(got)
    assert all(len(r.dates) == r.size == len(r.path) and sum(m.net for m in r.path) == r.amount_paise for r in got)
    capped = find_subsets(spark.createDataFrame([("V", 7 * 12)], TARGETS), pool, cap=30).collect()
    want = list(itertools.islice(itertools.combinations([f"INV-{i:04d}" for i in range(24)], 12), 30))
    assert sorted(tuple(r.members) for r in capped) == sorted(want)


def test_halves_meet_for_every_number_of_moves(spark):
    pool = spark.createDataFrame([invoice(i, 2 ** i) for i in range(9)], POOL)
    targets = spark.createDataFrame([("V", t) for t in range(1, 512)], TARGETS)
    got = {r.amount_paise: [m.net for m in r.moves] for r in moves_of(targets, pool, salts=3).collect()}
    assert all(got[t] == [2 ** i for i in range(9) if t >> i & 1] for t in range(1, 512))
    some = moves_of(targets, pool, max_moves=4).collect()
    assert len(some) == sum(1 for t in range(1, 512) if bin(t).count("1") <= 4)


def test_contests_of_one_component_settle_together(spark):
    """Pairs of one net share a credit with the set of both; later invoices tie all pairs together. Rounds don't grow with the pairs."""
    taken = []
    for contests in (3, 8):
        nets = [1000 * 3 ** c for c in range(contests)]  # no other two of them add up to the same
        pool = [invoice(2 * c + j, net, "Zenith Foods", day=-100) for c, net in enumerate(nets) for j in range(2)]
        credits = [credit(c, 2 * net, "x", day=300) for c, net in enumerate(nets)]
        for c in range(contests - 1):
            pool.append(invoice(900 + c, nets[c] + nets[c + 1], "Later", day=-100))
            credits.append(credit(900 + c, nets[c] + nets[c + 1], "x", day=300))
        anchors = {f"INV-{2 * c + j:04d}": f"u{c}" for c in range(contests) for j in range(2)}
        settle = [("V", f"p{no}", no, utr, 1, "", "processed", 0, 0, 1) for no, utr in anchors.items()]
        rounds = []
        outcomes, _ = reconcile_in_order(
            spark.createDataFrame(pool, POOL).withColumn("run_order", F.col("invoice_number")), spark.createDataFrame(settle, SETTLE),
            spark.createDataFrame(credits, CREDITS), max_size=2, rounds=rounds)
        got = {r.document_id: r.terminal for r in outcomes.collect()}
        assert [got[f"d{2 * c}"] for c in range(contests)] == ["LEDGER_COMMITTED"] * contests
        assert [got[f"d{2 * c + 1}"] for c in range(contests)] == ["ALREADY_COMMITTED"] * contests
        assert [got[f"d{900 + c}"] for c in range(contests - 1)] == ["LEDGER_COMMITTED"] * (contests - 1)
        taken.append(len(rounds))
    assert taken[0] == taken[1] <= 3


@pytest.mark.parametrize("seed", [21, 22])
def test_batch_in_order_with_many_collisions(spark, seed):
    """Two vendors, few nets, credits without UTR, anchors to each other's credits: equal to one at a time."""
    rng = random.Random(seed)
    pool = [invoice(i, rng.choice([2, 3, 4, 6, 7]), "Zenith Foods", day=-100, vendor=f"V{i % 2}") for i in range(16)]
    credits = [credit(i, rng.choice([2, 3, 5, 6, 13, 14]), vendor=f"V{i % 2}", utr=None if i % 7 == 3 else f"u{i}") for i in range(14)]
    settle = [(p[1], f"p{p[2]}", p[2], f"u{rng.choice([c for c in range(14) if c % 2 == int(p[1][1])])}", 1, "", "processed", 0, 0, 1)
              for p in pool if rng.random() < 0.6]
    outcomes, posted = reconcile_in_order(
        spark.createDataFrame(pool, POOL).withColumn("run_order", F.col("invoice_number")), spark.createDataFrame(settle, SETTLE),
        spark.createDataFrame(credits, CREDITS))
    want = {}
    for vendor in ("V0", "V1"):
        anchors = {s[2]: s[3] for s in settle if s[0] == vendor}
        want.update(by_hand_in_order([p for p in pool if p[1] == vendor], [c for c in credits if c[0] == vendor], anchors))
    assert {r.document_id: r.terminal for r in outcomes.collect()} == want
    numbers = [(r.vendor_code, r.invoice_number) for r in posted.collect()]
    assert len(numbers) == len(set(numbers))


def test_labels_jump_along_long_paths(spark):
    edges = [(f"n{i:03}", f"h{i}") for i in range(60)] + [(f"n{i + 1:03}", f"h{i}") for i in range(60)]
    got = {r.component for r in connected(spark.createDataFrame(edges, "node string, hub string")).collect()}
    assert got == {"n000"}


def test_requests_nobody_may_make_are_refused(spark):
    from ledgerloom.tools import match
    rows = [("a", "V", "INV-0001", "u1", None, "u1", None, 500), ("b", "V", "INV-0001", "u9", None, "u1", None, 500),
            ("c", "V", "INV-0001", "u1", None, None, "u1", 500), ("d", "V", "INV-0001", None, 500, None, None, 500),
            ("e", "V", "INV-0001", None, 501, None, None, 500), ("f", "V", "INV-0001", "", None, "", "", 500)]
    requests = spark.createDataFrame(rows, "document_id string, vendor_code string, invoice_number string, request_utr string,"
                                     " request_paise bigint, anchor_utr string, fuzzy_utr string, target_paise bigint")
    got = match(requests, spark.createDataFrame([credit(1, 500), credit(9, 500)], CREDITS), spark.createDataFrame([invoice(1, 500)], POOL))
    assert {r.document_id: (r.subset_status, r.guard_reason) for r in got.collect()} == {
        "a": ("SUBSET_MATCHED", None), "b": ("PREREQUISITE_FAILED", "UTR_NOT_RESOLVED"), "c": ("SUBSET_MATCHED", None),
        "d": ("AMBIGUOUS_COLLISION", None), "e": ("PREREQUISITE_FAILED", "TARGET_DIFFERS"), "f": ("PREREQUISITE_FAILED", "UTR_NOT_RESOLVED")}


def test_small_vendors_are_folded_without_rounds(spark):
    """Folded, in rounds, or one vendor each: the same outcomes and postings; names, dates and missing UTRs decide too."""
    rng = random.Random(31)
    names = ["Zenith Foods", "Blue Widget Works", "Acme Plate"]
    pool = [invoice(i, rng.choice([2, 3, 4, 6]), rng.choice(names), day=rng.randint(-9, 9), vendor="V0" if i < 9 else "V1") for i in range(14)]
    credits = [credit(i, rng.choice([2, 3, 5, 6, 9]), rng.choice(names).upper(), day=rng.randint(-9, 9), vendor=f"V{i % 2}",
                      utr=None if i % 6 == 3 else f"u{i}") for i in range(12)]
    settle = [(p[1], f"p{p[2]}", p[2], f"u{rng.choice([c for c in range(12) if c % 2 == int(p[1][1])])}", 1, "", "processed", 0, 0, 1)
              for p in pool if rng.random() < 0.4]
    results, taken = [], []
    for bounds in ({}, {"fold_looks": 0}, {"fold_looks": 60, "fold_options": 10 ** 6}):
        rounds = []
        outcomes, posted = reconcile_in_order(
            spark.createDataFrame(pool, POOL).withColumn("run_order", F.col("invoice_number")), spark.createDataFrame(settle, SETTLE),
            spark.createDataFrame(credits, CREDITS), rounds=rounds, **bounds)
        results.append((sorted(map(str, outcomes.collect())), sorted(map(str, posted.collect()))))
        taken.append(len(rounds))
    assert results[0] == results[1] == results[2] and len(results[0][0]) == 14 and results[0][1]
    assert taken[0] == 0 < taken[1]


def test_named_invoices_are_derived_once(spark):
    """Invoices, settlements and bank lines of a query read the names from one table of files."""
    from ledgerloom.sources.fixtures import Fixtures
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    plain = fx.invoices_named()
    fx.share_names()
    shared = fx.invoices_named()
    assert "Join" not in shared._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, shared.collect())) == sorted(map(str, plain.collect())) and shared.columns == plain.columns


def test_snapshot_ships_what_it_uses(spark, monkeypatch):
    """Columns that decide nothing are in no step's files, rows are not kept as checkpoints, and the outcomes are right."""
    from pyspark.sql import DataFrame

    from ledgerloom import scale, tools
    from ledgerloom.operators import linking, matching, posting, subsets
    pool = [invoice(1, 500), invoice(2, 300), invoice(3, 200), invoice(4, 700, "Zenith Foods"), invoice(5, 900)]
    credits = [credit(1, 500), credit(2, 500, "NEFT/2/HDFC/OTHERS"), credit(3, 700, "NEFT/3/HDFC/ZENITH FOODS"), credit(5, 900, utr=None)]
    paid = [("V", "p1", "INV-0001", "u1", 500, "ACME TOOLS", "processed", 0, 0, 1),
            ("V", "p4", "INV-0009", "u3", 700, "NEFT/3/HDFC/ZENITH FOODS", "processed", 0, 0, 2)]
    files = []

    def noted(df):
        files.append(df.columns)
        return scale.written(df)

    for module in (tools, linking, matching, posting, subsets):
        monkeypatch.setattr(module, "written", noted)
    monkeypatch.setattr(DataFrame, "checkpoint", None)
    posted, outcomes = tools.reconcile_snapshot(
        spark.createDataFrame(pool, POOL).withColumn("scan", F.lit("x" * 100)), spark.createDataFrame(paid, SETTLE),
        spark.createDataFrame(credits, CREDITS), spark.createDataFrame([], "document_id string"))
    got = {r.document_id: (r.terminal, r.utr, r.review_reason) for r in outcomes.collect()}
    assert got["d1"] == ("LEDGER_COMMITTED", "u1", None) and got["d4"] == ("LEDGER_COMMITTED", "u3", None)
    assert got["d5"] == ("EXCEPTION_ROUTED", None, "REASON_UNSPECIFIED") and len(got) == 5
    assert {(r.document_id, r.payout_id) for r in posted.collect()} == {("d1", "p1"), ("d4", None)}
    assert not any({"scan", "narration", "path"} & set(f) for f in files if "sum" not in f)


def test_lengths_no_name_can_match_are_left_out(spark):
    from ledgerloom.operators import linking
    names = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "__a array<string>")
    told = spark.createDataFrame([(["a"],), (["a", "b", "b"],), (["a", "b", "c"],), ([],)], "__b array<string>")
    assert sorted(linking._fitting_sizes(names, told, 0.85)) == [(0, 0), (2, 2)]
    assert (7, 6) in linking._fitting_sizes(spark.createDataFrame([(list("abcdefg"),)], "__a array<string>"),
                                            spark.createDataFrame([(list("abcdef"),)], "__b array<string>"), 0.85)
