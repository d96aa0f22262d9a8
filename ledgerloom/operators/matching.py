"""Which credit settles which invoices: amount first, then supplier name, then date, else review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import days_apart
from ledgerloom.functions.labels import exception_reason
from ledgerloom.functions.text import MATCH_THRESHOLD, narration_tokens, source_tokens
from ledgerloom.operators.linking import MISMATCH, RESOLVED, best_settlement, distinct_scores, score_distinct_pairs
from ledgerloom.operators.reads import with_anchor
from ledgerloom.operators.subsets import find_subsets
from ledgerloom.scale import spread_nulls, written

# Outcomes of a matching request, and the default date tolerance.
MATCHED, NO_MATCH, AMBIGUOUS = "SUBSET_MATCHED", "NO_MATCH", "AMBIGUOUS_COLLISION"
TOLERANCE_DAYS = 7

REQUEST = ["vendor_code", "request_utr", "request_paise"]

# Columns of a name's and a narration's words, for callers that match many times and find them once.
NAME_WORDS, WORDS = "__a", "__b"


# Why a request isn't asked: a UTR nothing resolved for the invoice, or a target that isn't its own.
UTR_NOT_RESOLVED, TARGET_DIFFERS = "UTR_NOT_RESOLVED", "TARGET_DIFFERS"


def request_guard(requests: DataFrame) -> DataFrame:
    """``guard_reason`` of requests somebody else made, NULL for one that may be asked.

    A UTR must be the invoice's anchor or the one found by its supplier's name (``fuzzy_utr``, where there is that column); a
    target must be the anchored amount or the expected net (``target_paise``).
    """
    known = [F.col(c) for c in ("anchor_utr", "fuzzy_utr") if c in requests.columns]
    found = F.lit(False)
    for utr in known:
        found = found | F.coalesce((F.col("request_utr") == utr) & (utr != ""), F.lit(False))
    own = F.coalesce(F.col("request_paise") == F.col("target_paise"), F.lit(False))
    return requests.withColumn("guard_reason", F.when(F.col("request_utr").isNotNull() & ~found, UTR_NOT_RESOLVED).when(
        F.col("request_paise").isNotNull() & ~own, TARGET_DIFFERS))


def request_of(invoices: DataFrame) -> DataFrame:
    """The request an invoice makes: the anchored UTR, or else its target amount."""
    return invoices.withColumns({
        "request_utr": F.col("anchor_utr"),
        "request_paise": F.when(F.col("anchor_utr").isNull(), F.col("target_paise"))})


def _key(utr: str, paise: str) -> Column:
    """One join key for both kinds of request; NULL when it asks for nothing."""
    return F.coalesce(F.concat(F.lit("utr:"), F.col(utr)), F.concat(F.lit("paise:"), F.col(paise).cast("string")))


def request_key() -> Column:
    """Name of a request of a vendor, for rows that carry one; NULL when it asks for nothing."""
    key = _key("request_utr", "request_paise")
    return F.when(key.isNotNull(), F.concat_ws("|", "vendor_code", key))


def requested_credits(requests: DataFrame, credits: DataFrame) -> DataFrame:
    """Credits of each distinct request: those with its UTR, whatever the amount; or those with its amount.

    Each kind is an equi-join of its own on the columns as they are, and falls away where no request can be of that kind.
    """
    rows = credits.select("vendor_code", "transaction_id", "utr_number", "transaction_date", "amount_paise",
                          *[c for c in ("narration", WORDS) if c in credits.columns])
    wanted = requests.select(*REQUEST)
    by_utr = wanted.filter("request_utr IS NOT NULL").distinct().withColumn("utr_number", F.col("request_utr"))
    by_amount = wanted.filter("request_utr IS NULL AND request_paise IS NOT NULL").distinct().withColumn(
        "amount_paise", F.col("request_paise"))
    return rows.join(by_utr, ["vendor_code", "utr_number"]).unionByName(rows.join(by_amount, ["vendor_code", "amount_paise"]))


def matching_units(requests: DataFrame, credits: DataFrame, invoices: DataFrame, max_size: int | None = None,
                   salts: int | None = None, subsets: DataFrame | None = None) -> DataFrame:
    """Every (credit, set) option of each request, credits alike in all that matters counted as one row.

    Alike means same amount, date and narration words: ``n`` says how many options a row stands for, and
    the row names one of them. Credits nobody asks for are left out before the others are counted, which happens before
    they are shipped: an amount shared by very many credits yields few rows per task, and one row per set, date and narration.
    """
    if WORDS not in credits.columns:
        credits = written(credits.select("vendor_code", "transaction_id", "utr_number", "transaction_date", "amount_paise",
                                         narration_tokens("narration").alias(WORDS)))
    groups = requested_credits(requests, credits).groupBy(*REQUEST, "amount_paise", "transaction_date", WORDS).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("transaction_id", "utr_number")).alias("credit"))
    if subsets is None:
        groups = written(groups)
        subsets = find_subsets(groups.select("vendor_code", "amount_paise"), invoices, max_size, salts)
    return groups.join(subsets, ["vendor_code", "amount_paise"])


def named_units(units: DataFrame) -> DataFrame:
    """Options of one member, with the words of its supplier's name."""
    single = units.filter("size = 1")
    return single if NAME_WORDS in units.columns else single.withColumn(NAME_WORDS, source_tokens("supplier"))


def scored_units(units: DataFrame, tolerance_days: int = TOLERANCE_DAYS,
                 threshold: float = MATCH_THRESHOLD, scores: DataFrame | None = None) -> DataFrame:
    """Options with ``score`` (0 below the threshold and for larger sets) and ``delta`` (NULL beyond the tolerance).

    ``scores``: the score of each pair of words (name, narration), if they are known from an earlier call."""
    gap = F.array_min(F.transform(F.array_compact("dates"), lambda d: days_apart(F.col("transaction_date"), d)))
    single = named_units(units)
    scored = (score_distinct_pairs(single, NAME_WORDS, WORDS).drop("phonetic") if scores is None
              else single.join(scores, [NAME_WORDS, WORDS], "left"))
    rest = units.filter("size <> 1").drop(NAME_WORDS).withColumn("score", F.lit(0.0))
    return scored.drop(NAME_WORDS).unionByName(rest).withColumns({
        "score": F.when(F.col("score") >= threshold, F.col("score")).otherwise(F.lit(0.0)),
        "delta": F.when(gap <= tolerance_days, gap)})


def decide(scored: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """One verdict per request that has options: status, phase and the winning option.

    Options are first counted per (score, delta). Scores below the threshold and deltas beyond the
    tolerance are folded together, so the list kept per request is small whatever the data.
    """
    option = F.struct("members", F.col("credit.transaction_id").alias("transaction_id"),
                      F.col("credit.utr_number").alias("utr"), "transaction_date", "amount_paise")
    counted = scored.groupBy(*REQUEST, "score", "delta").agg(F.sum("n").alias("n"), F.min(option).alias("o"))
    per = counted.groupBy(*REQUEST).agg(F.collect_list(F.struct("score", "delta", "n", "o")).alias("c"))

    def count(rows: Column) -> Column:
        return F.aggregate(rows, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])

    c = F.col("c")
    top = F.array_max(F.transform(c, lambda x: x["score"]))
    near = F.array_min(F.transform(c, lambda x: x["delta"]))
    named = per.withColumns({"best": F.filter(c, lambda x: x["score"] == top),
                             "closest": F.filter(c, lambda x: x["delta"] == near), "top": top})
    phase = (F.when(count(c) == 1, 1)
             .when((F.col("top") >= threshold) & (count(F.col("best")) == 1), 2)
             .when(count(F.col("closest")) == 1, 3))
    winner = F.when(F.col("phase") == 1, c[0]["o"]).when(F.col("phase") == 2, F.get("best", F.lit(0))["o"]).when(
        F.col("phase") == 3, F.get("closest", F.lit(0))["o"])
    return named.withColumn("phase", phase).withColumn("w", winner).select(
        *REQUEST, F.when(F.col("phase").isNull(), AMBIGUOUS).otherwise(MATCHED).alias("subset_status"), "phase",
        count(c).alias("options"), F.col("w.members").alias("matched_invoices"), F.col("w.utr").alias("matched_utr"),
        F.col("w.transaction_id").alias("transaction_id"), F.col("w.transaction_date").alias("bank_date"),
        F.col("w.amount_paise").alias("proof_paise"))


def match_requests(requests: DataFrame, credits: DataFrame, invoices: DataFrame,
                   tolerance_days: int = TOLERANCE_DAYS, max_size: int | None = None, salts: int | None = None,
                   subsets: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """``requests`` rows with the verdict of their request; one without any option is NO_MATCH."""
    units = matching_units(requests, credits, invoices, max_size, salts, subsets)
    if scores is None:
        words = F.when(F.col("size") == 1, source_tokens("supplier"))
        units = written((units if NAME_WORDS in units.columns else units.withColumn(NAME_WORDS, words)).drop("path", "supplier"))
        # From files the size of the scores is known: few of them are broadcast, and no options shipped to them.
        scores = written(distinct_scores(named_units(units), NAME_WORDS, WORDS).drop("phonetic"))
    verdicts = decide(scored_units(units, tolerance_days, scores=scores)).withColumn(
        "key", _key("request_utr", "request_paise")).drop("request_utr", "request_paise")
    # A request for nothing gets a key of its own row, so that such rows do not meet in one partition.
    row = F.col("document_id" if "document_id" in requests.columns else "vendor_code")
    keyed = requests.withColumn("key", spread_nulls(_key("request_utr", "request_paise"), row))
    return keyed.join(verdicts, ["vendor_code", "key"], "left").drop("key").withColumns({
        "subset_status": F.coalesce("subset_status", F.lit(NO_MATCH)), "options": F.coalesce("options", F.lit(0))})


def settle(verdicts: DataFrame) -> DataFrame:
    """A proof that leaves the invoice out reads as NO_MATCH for it."""
    member = F.coalesce(F.array_contains("matched_invoices", F.col("invoice_number")), F.lit(False))
    return verdicts.withColumn("committable", (F.col("subset_status") == MATCHED) & member).withColumn(
        "subset_status", F.when((F.col("subset_status") == MATCHED) & ~member, NO_MATCH).otherwise(F.col("subset_status")))


def fast_path(invoices: DataFrame, settlements: DataFrame, credits: DataFrame, pool: DataFrame | None = None,
              **options) -> DataFrame:
    """Deterministic verdict per open invoice: anchor, request, match, membership.

    ``committable`` invoices carry a proof naming them; all others go to :func:`resolve_exceptions`.
    """
    asked = written(request_of(with_anchor(invoices, settlements)))
    return settle(match_requests(asked, credits, pool if pool is not None else invoices, **options))


def resolve_exceptions(unresolved: DataFrame, settlements: DataFrame, credits: DataFrame, pool: DataFrame,
                       **options) -> DataFrame:
    """Second chance by supplier name: a settlement that names the supplier anchors a new request.

    Rows keep their earlier columns; ``committable`` now tells whether the second request proved the
    invoice, ``review_reason`` why it goes to a person if not.
    """
    keep = [c for c in unresolved.columns if c not in (
        "subset_status", "phase", "options", "matched_invoices", "matched_utr", "transaction_id", "bank_date",
        "proof_paise", "committable", "request_utr", "request_paise")]
    first = unresolved.select(*keep, F.col("subset_status").alias("first_status"))
    # Links feed both the requests and the result; the residue is small, and is linked once.
    linked = written(first.join(best_settlement(first, settlements), ["vendor_code", "supplier_legal_name"], "left"))
    asked = linked.withColumns({"request_utr": F.col("fuzzy_utr"), "request_paise": F.lit(None).cast("long")})
    done = settle(match_requests(asked, credits, pool, **options)).withColumns({
        "subset_status": F.when(F.col("fuzzy_utr").isNull(), F.col("first_status")).otherwise(F.col("subset_status")),
        "fuzzy_status": F.when(F.col("fuzzy_utr").isNull(), MISMATCH).otherwise(RESOLVED)})
    return done.withColumn("review_reason", F.when(~F.col("committable"), exception_reason(
        F.col("subset_status"), F.col("fuzzy_status"), F.lit(None).cast("string"))))
