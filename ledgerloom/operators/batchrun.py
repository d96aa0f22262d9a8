"""Reconciliation of whole batches with the result of processing invoices one at a time, in order.

Each commit takes its credit and its invoices out of the pool, so later invoices see fewer options. An invoice can be
settled on the present pool once no earlier one can change what it sees, whatever that one's verdict will be. Every round
judges all waiting invoices on the present pool and settles all that are safe:

* in a component (invoices connected through options) nothing changes before its first commit; from there on every invoice
  may change what its options take: their credits and the members of the sets that hold it;
* an invoice is safe if no such earlier invoice may take a credit or a member of its options, or the invoice itself;
* a safe commit waits while an earlier invoice that isn't settled for sure still looks at what it takes.

Contests that don't touch each other are settled in the same round, also inside one component, and so are runs of invoices
that can't commit; the number of rounds follows the longest chain of contests that wait for each other. Options are kept
by request, amount and set, never by pair of invoices. Outcomes of a round are files that no later round rewrites.

Vendors share nothing, so those with few options need no rounds: each one's invoices are folded in order within its row
(:func:`_one_by_one`), all vendors at once. Only vendors beyond the bounds below go through rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import MATCH_THRESHOLD, narration_tokens, source_tokens
from ledgerloom.operators import matching
from ledgerloom.operators.linking import score_distinct_pairs
from ledgerloom.operators.reads import with_anchor
from ledgerloom.operators.subsets import find_subsets
from ledgerloom.scale import spread_nulls, written

# A vendor is taken invoice by invoice in one row up to so many options, and so many looks of its invoices at options.
FOLD_OPTIONS, FOLD_LOOKS = 20_000, 1_000_000

# Terminal states of an invoice in a run.
LEDGER_COMMITTED, ALREADY_COMMITTED, UNRESOLVED = "LEDGER_COMMITTED", "ALREADY_COMMITTED", "EXCEPTION_ROUTED"


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for bipartite ``edges`` (node, hub): smallest node label reachable.

    Labels go from node to hub to node as pre-aggregated minima, then each node takes the label of its label, so that
    rounds follow the logarithm of the longest path.
    """
    edges = written(edges.distinct())
    labels = written(edges.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        hubs = edges.join(labels, "node").groupBy("hub").agg(F.min("component").alias("component"))
        lower = edges.join(hubs, "hub").groupBy("node").agg(F.min("component").alias("lower"))
        spread = written(labels.join(lower, "node").select(
            "node", F.least("component", "lower").alias("component"), (F.col("lower") < F.col("component")).alias("moved")))
        if spread.filter("moved").isEmpty():
            return spread.select("node", "component")
        # The label of the label, once for each label in use.
        above = spread.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = written(spread.join(above, "component").select("node", F.least("component", "next").alias("component")))


def _named(kind: str, *columns: str) -> Column:
    return F.concat_ws("|", F.lit(kind), *[F.col(c).cast("string") for c in columns])


class _Options:
    """What requests look at, in tables whose sizes add up: request to amount and UTR, amount to set, set to member."""

    def __init__(self, asked: DataFrame, credits: DataFrame, subsets: DataFrame):
        wanted = matching.requested_credits(asked, credits).withColumn("q", matching.request_key())
        self.amounts = written(wanted.select("q", _named("amt", "vendor_code", "amount_paise").alias("a")).distinct())
        self.utrs = written(wanted.filter("utr_number IS NOT NULL").select(
            "q", _named("utr", "vendor_code", "utr_number").alias("r")).distinct())
        sets = subsets.select(_named("amt", "vendor_code", "amount_paise").alias("a"), "vendor_code", F.to_json("path").alias("path"),
                              F.explode("members").alias("m"))
        self.sets = written(sets.select("a", F.concat_ws("|", "a", "path").alias("s"), _named("inv", "vendor_code", "m").alias("r")))
        self.members = written(self.sets.select("a", "r").distinct())

    def links(self) -> DataFrame:
        """Edges (node, hub) that connect invoices through options."""
        asks = self.amounts.select(F.col("q").alias("node"), F.col("a").alias("hub"))
        shared = self.utrs.select(F.col("q").alias("node"), F.col("r").alias("hub"))
        return asks.unionByName(shared).unionByName(self.members.select(F.col("r").alias("node"), F.col("a").alias("hub")))

    def places(self, asked: DataFrame) -> DataFrame:
        """(own, q, s): the sets of its request that hold an invoice; only those can it commit."""
        return asked.join(self.amounts, "q").select("own", "q", "a").join(
            self.sets.withColumnRenamed("r", "own"), ["own", "a"]).select("own", "q", "s")


def _least(rows: DataFrame, key: str, value: str = "first") -> DataFrame:
    return rows.groupBy(key).agg(F.min(value).alias(value))


def _first_takers(options: _Options, places: DataFrame, takers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first of ``takers`` (own, run_order) that may take something of each request's options; and each member."""
    able = places.join(takers.select("own", F.col("run_order").alias("first")), "own")
    members = _least(options.sets.join(_least(able, "s"), "s"), "r")
    by_amount = _least(options.members.join(members, "r"), "a")
    utrs = _least(options.utrs.join(_least(able, "q"), "q"), "r")
    requests = options.amounts.join(by_amount, "a").select("q", "first").unionByName(
        options.utrs.join(utrs, "r").select("q", "first"))
    return _least(requests, "q"), members.select(F.col("r").alias("own"), F.col("first").alias("own_first"))


def _first_viewers(options: _Options, viewers: DataFrame) -> DataFrame:
    """(r, first): the first of ``viewers`` (own, q, run_order) that looks at each credit and member."""
    requests = _least(viewers.select("q", F.col("run_order").alias("first")), "q")
    members = options.members.join(_least(options.amounts.join(requests, "q"), "a"), "a").select("r", "first")
    utrs = options.utrs.join(requests, "q").select("r", "first")
    return _least(members.unionByName(utrs).unionByName(viewers.select(F.col("own").alias("r"), F.col("run_order").alias("first"))), "r")


def _safe(options: _Options, places: DataFrame, judged: DataFrame) -> DataFrame:
    """``judged`` with ``settled``: whether the verdict on the present pool is final."""
    commits = judged.filter("__can")
    opening = commits.groupBy("component").agg(F.min("run_order").alias("opening"))
    placed = judged.join(opening, "component", "left")
    takers = placed.filter("run_order >= opening").select("own", "run_order")
    by_request, by_member = _first_takers(options, places, takers)
    seen = placed.withColumn("key", spread_nulls(F.col("q"), F.col("own"))).join(
        by_request.select(F.col("q").alias("key"), "first"), "key", "left").join(by_member, "own", "left").drop("key", "opening")
    late = F.least("first", "own_first")
    seen = written(seen.withColumn("safe", late.isNull() | (F.col("run_order") <= late)).drop("first", "own_first"))
    # A commit waits for earlier invoices that may have to look again, or may wait themselves.
    viewers = _first_viewers(options, seen.filter("NOT safe OR __can"))
    taken = F.concat(F.transform("matched_invoices", lambda m: F.concat_ws("|", F.lit("inv"), F.col("vendor_code"), m)),
                     F.array(_named("utr", "vendor_code", "matched_utr")))
    waits = seen.filter("safe AND __can").select("own", "run_order", F.explode(taken).alias("r")).join(viewers, "r").filter(
        "first < run_order").select("own").distinct().withColumn("waits", F.lit(True))
    return seen.join(waits, "own", "left").withColumn("settled", F.col("safe") & F.col("waits").isNull()).drop("safe", "waits")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is then evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _large_vendors(asked: DataFrame, credits: DataFrame, subsets: DataFrame, options: int, looks: int) -> DataFrame:
    """Vendors that may have more than ``options`` options or ``looks`` of an invoice at an option."""
    per_amount = subsets.groupBy("vendor_code", "amount_paise").agg(F.count(F.lit(1)).alias("sets"))
    sets = per_amount.groupBy("vendor_code").agg(F.max("sets").alias("sets"))
    # A credit answers to its UTR and to its amount.
    answers = credits.groupBy("vendor_code").agg((2 * F.count(F.lit(1))).alias("answers"))
    sizes = asked.groupBy("vendor_code").agg(F.count(F.lit(1)).alias("invoices")).join(sets, "vendor_code", "left").join(
        answers, "vendor_code", "left")
    most = F.coalesce(F.col("sets") * F.col("answers"), F.lit(0))
    return sizes.filter((most > options) | (F.greatest(most, F.col("invoices")) * F.col("invoices") > looks)).select("vendor_code")


def _one_by_one(asked: DataFrame, credits: DataFrame, subsets: DataFrame, tolerance_days: int) -> DataFrame:
    """Outcome of each invoice, taken in ``run_order`` within its vendor's row; what a commit takes is gone for the next."""
    units = matching.requested_credits(asked, credits).join(subsets, ["vendor_code", "amount_paise"])
    option = F.struct(matching.request_key().alias("q"), F.col("utr_number").alias("utr"), "members", "score", "delta")
    options = matching.scored_units(units, tolerance_days).groupBy("vendor_code").agg(F.collect_list(option).alias("options"))
    lines = asked.groupBy("vendor_code").agg(F.array_sort(F.collect_list(F.struct(
        "run_order", "document_id", "invoice_number", "q", "anchor_payout_id"))).alias("lines"))
    done = ("array<struct<document_id:string,terminal:string,subset_status:string,phase:int,utr:string,members:array<string>,"
            "anchor_payout_id:string>>")

    def verdict(free: Column, line: Column) -> Column:
        top = F.array_max(F.transform(free, lambda o: o["score"]))
        near = F.array_min(F.transform(free, lambda o: o["delta"]))
        return _let(F.struct(F.filter(free, lambda o: o["score"] == top).alias("best"),
                             F.filter(free, lambda o: o["delta"] == near).alias("closest"), top.alias("top")), lambda v: _let(
            F.when(F.size(free) == 1, F.struct(F.lit(1).alias("phase"), F.get(free, F.lit(0)).alias("o")))
            .when((v["top"] >= MATCH_THRESHOLD) & (F.size(v["best"]) == 1), F.struct(F.lit(2).alias("phase"), F.get(v["best"], F.lit(0)).alias("o")))
            .when(F.size(v["closest"]) == 1, F.struct(F.lit(3).alias("phase"), F.get(v["closest"], F.lit(0)).alias("o"))),
            lambda w: outcome(free, line, w)))

    def outcome(free: Column, line: Column, w: Column) -> Column:
        member = F.coalesce(F.array_contains(w["o"]["members"], line["invoice_number"]), F.lit(False))
        commits = member & w["o"]["utr"].isNotNull()
        status = F.when((F.size(free) == 0) | (w.isNotNull() & ~member), matching.NO_MATCH).when(
            w.isNull(), matching.AMBIGUOUS).otherwise(matching.MATCHED)
        return row(line, F.when(commits, LEDGER_COMMITTED).otherwise(UNRESOLVED), status, w["phase"],
                   F.when(commits, w["o"]["utr"]), F.when(commits, w["o"]["members"]))

    def row(line: Column, terminal: Column, status: Column, phase: Column, utr: Column, members: Column) -> Column:
        return F.struct(line["document_id"].alias("document_id"), terminal.alias("terminal"), status.alias("subset_status"),
                        phase.cast("int").alias("phase"), utr.cast("string").alias("utr"), members.cast("array<string>").alias("members"),
                        line["anchor_payout_id"].alias("anchor_payout_id"))

    def step(acc: Column, line: Column) -> Column:
        free = F.filter("options", lambda o: (o["q"] == line["q"]) & ~F.arrays_overlap(o["members"], acc["gone"])
                        & ~F.coalesce(F.array_contains(acc["utrs"], o["utr"]), F.lit(False)))
        none = F.lit(None)
        judged = F.when(F.array_contains(acc["gone"], line["invoice_number"]), row(line, F.lit(ALREADY_COMMITTED), none.cast("string"), none, none, none)
                        ).otherwise(_let(free, lambda found: verdict(found, line)))
        return _let(judged, lambda r: F.struct(
            F.when(r["utr"].isNotNull(), F.array_append(acc["utrs"], r["utr"])).otherwise(acc["utrs"]).alias("utrs"),
            F.when(r["utr"].isNotNull(), F.concat(acc["gone"], r["members"])).otherwise(acc["gone"]).alias("gone"),
            F.array_append(acc["done"], r).alias("done")))

    def empty(kind: str) -> Column:
        return F.expr(f"cast(array() AS {kind})")

    start = F.struct(empty("array<string>").alias("utrs"), empty("array<string>").alias("gone"), empty(done).alias("done"))
    rows = lines.join(options, "vendor_code", "left").withColumn(
        "options", F.coalesce("options", empty("array<struct<q:string,utr:string,members:array<string>,score:double,delta:int>>")))
    return rows.select("vendor_code", F.explode(F.aggregate("lines", start, step, lambda acc: acc["done"])).alias("r")).select("vendor_code", "r.*")


def reconcile_in_order(invoices: DataFrame, settlements: DataFrame, credits: DataFrame,
                       tolerance_days: int = matching.TOLERANCE_DAYS, max_size: int | None = None,
                       salts: int | None = None, rounds: list[int] | None = None,
                       fold_options: int = FOLD_OPTIONS, fold_looks: int = FOLD_LOOKS) -> tuple[DataFrame, DataFrame]:
    """(outcomes, posted) of open ``invoices`` taken in ``run_order``, a sortable column without ties.

    Outcomes: document_id, terminal, subset_status, phase, utr. Posted: one row per invoice cleared, with
    the UTR and the document that committed it. A proof without a UTR cannot be posted and goes to review.
    Vendors within ``fold_options`` and ``fold_looks`` are folded, the others settled in rounds, with the same result.
    ``rounds`` is given the number of invoices left after each round.
    """
    asked = written(matching.request_of(with_anchor(invoices, settlements)).withColumns({
        "own": _named("inv", "vendor_code", "invoice_number"), "q": matching.request_key()}).select(
        "vendor_code", "document_id", "invoice_number", "document_date", "supplier_legal_name", "net_paise", "request_utr",
        "request_paise", "anchor_payout_id", "run_order", "own", "q"))
    credits = written(credits.select("vendor_code", "transaction_id", "utr_number", "transaction_date", "amount_paise",
                                     narration_tokens("narration").alias(matching.WORDS)))
    targets = matching.requested_credits(asked, credits).select("vendor_code", "amount_paise").distinct()
    subsets = written(find_subsets(targets, asked, max_size, salts).withColumn(matching.NAME_WORDS, source_tokens("supplier")))
    large = written(_large_vendors(asked, credits, subsets, fold_options, fold_looks))
    if large.isEmpty():
        folded = written(_one_by_one(asked, credits, subsets, tolerance_days))
        outcomes, posted = [], []
    else:
        of_large = [df.join(large, "vendor_code", "left_semi") for df in (asked, credits, subsets)]
        outcomes, posted = _in_rounds(*[written(df) for df in of_large], tolerance_days, rounds)
        folded = written(_one_by_one(*[df.join(large, "vendor_code", "left_anti") for df in (asked, credits, subsets)], tolerance_days))
    outcomes.append(folded.select("document_id", "terminal", "subset_status", "phase", "utr"))
    posted.append(folded.filter("utr IS NOT NULL").select(
        "vendor_code", F.explode("members").alias("invoice_number"), "utr", F.col("document_id").alias("committed_by"), "anchor_payout_id"))
    return reduce(DataFrame.unionByName, outcomes), reduce(DataFrame.unionByName, posted)


def _in_rounds(asked: DataFrame, credits: DataFrame, subsets: DataFrame, tolerance_days: int,
               rounds: list[int] | None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Outcomes and posted rows of each round."""
    # Names are compared once; later rounds see fewer options, never new ones.
    every = matching.named_units(matching.matching_units(asked, credits, asked, subsets=subsets)).select(matching.NAME_WORDS, matching.WORDS)
    scores = written(score_distinct_pairs(every.distinct(), matching.NAME_WORDS, matching.WORDS).select(
        matching.NAME_WORDS, matching.WORDS, "score"))
    options = _Options(asked, credits, subsets)
    places = written(options.places(asked.filter("q IS NOT NULL")))
    asks = asked.filter("q IS NOT NULL").select(F.col("own").alias("node"), F.concat_ws("|", F.lit("req"), "q").alias("hub")).unionByName(
        asked.filter("q IS NOT NULL").select(F.col("q").alias("node"), F.concat_ws("|", F.lit("req"), "q").alias("hub")))
    components = connected(asks.unionByName(options.links()))
    waiting = written(asked.join(components.withColumnRenamed("node", "own"), "own", "left").withColumn(
        "component", F.coalesce("component", "own")))

    outcomes: list[DataFrame] = []
    cleared: list[DataFrame] = []
    while not waiting.isEmpty():
        free_sets, free_credits = subsets, credits
        if cleared:
            posted = reduce(DataFrame.unionByName, cleared)
            used = subsets.select("vendor_code", "amount_paise", "path", F.explode("members").alias("m")).join(
                posted.select("vendor_code", F.col("invoice_number").alias("m")), ["vendor_code", "m"]).select(
                "vendor_code", "amount_paise", "path").distinct()
            free_sets = subsets.join(used, ["vendor_code", "amount_paise", "path"], "left_anti")
            free_credits = credits.join(posted.select("vendor_code", F.col("utr").alias("utr_number")).distinct(),
                                        ["vendor_code", "utr_number"], "left_anti")
        judged = matching.settle(matching.match_requests(waiting, free_credits, asked, tolerance_days, subsets=free_sets, scores=scores))
        judged = written(judged.withColumn("__can", F.col("committable") & F.col("matched_utr").isNotNull()))
        placed = written(_safe(options, places, judged))
        commits = written(placed.filter("settled AND __can").select(
            "vendor_code", F.explode("matched_invoices").alias("invoice_number"), F.col("matched_utr").alias("utr"),
            F.col("document_id").alias("committed_by"), "anchor_payout_id"))
        # A verdict is final, or a commit of this round took the invoice, or it waits on.
        gone = commits.select("vendor_code", "invoice_number").withColumn("__gone", F.lit(True))
        after = written(placed.join(gone, ["vendor_code", "invoice_number"], "left").withColumn("terminal", (
            F.when(F.col("settled") & F.col("__can"), LEDGER_COMMITTED).when(F.col("settled"), UNRESOLVED).when(F.col("__gone"), ALREADY_COMMITTED))))
        seen = F.col("settled")
        outcomes.append(after.filter("terminal IS NOT NULL").select(
            "document_id", "terminal", F.when(seen, F.col("subset_status")).alias("subset_status"), F.when(seen, F.col("phase")).alias("phase"),
            F.when(F.col("terminal") == LEDGER_COMMITTED, F.col("matched_utr")).alias("utr")))
        cleared.append(commits)
        waiting = after.filter("terminal IS NULL").select(*waiting.columns)
        if rounds is not None:
            rounds.append(waiting.count())
    return outcomes, cleared
