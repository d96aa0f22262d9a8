"""Posting, outbox, tickets and gates on rows where plain rules go wrong."""

import json

from pyspark.sql import functions as F

from ledgerloom.functions import labels
from ledgerloom.operators import exceptions, posting, reports
from ledgerloom.sources.fixtures import Fixtures

PROOF = "proof_id string, vendor_code string, matched_invoices array<string>, matched_utr string, proof_paise long, payout_id string"
INVOICE = "vendor_code string, invoice_number string, document_id string, net_paise long"


def test_a_refused_proof_blocks_nothing(spark):
    invoices = spark.createDataFrame([("V", f"I{i}", f"d{i}", 10) for i in range(6)], INVOICE)
    proofs = spark.createDataFrame([("p1", "V", ["I1", "I2"], "u1", 20, "x"), ("p2", "V", ["I2"], "u2", 10, "x"), ("p3", "V", ["I2", "I3"], "u3", 20, "x"),
                                    ("p4", "V", ["I3", "I4"], "u4", 20, "x"), ("p5", "V", ["I5"], None, 10, "x")], PROOF)
    taken = spark.createDataFrame([("d1",)], "document_id string")
    posted, statuses = posting.post_matches(proofs, invoices, taken, F.col("proof_id"))
    assert {r.proof_id: r.posting_status for r in statuses.collect()} == {
        "p1": "DUPLICATE_EVENT", "p2": "LEDGER_COMMITTED", "p3": "DUPLICATE_EVENT", "p4": "LEDGER_COMMITTED", "p5": "PREREQUISITE_FAILED"}
    assert sorted(r.document_id for r in posted.collect()) == ["d2", "d3", "d4"]


def test_chains_of_contests_go_through_files(spark):
    """Each proof contends with its neighbours; what rounds hand on are files, no row checkpoints."""
    n = 7
    invoices = spark.createDataFrame([("V", f"I{i}", f"d{i}", 10) for i in range(n + 1)], INVOICE)
    proofs = spark.createDataFrame([(f"p{i}", "V", [f"I{i}", f"I{i + 1}"], f"u{i}", 20, "x") for i in range(n)], PROOF)
    _, statuses = posting.post_matches(proofs, invoices, spark.createDataFrame([], "document_id string"), F.col("proof_id"))
    assert {r.proof_id for r in statuses.filter("posting_status = 'LEDGER_COMMITTED'").collect()} == {"p0", "p2", "p4", "p6"}
    assert statuses.count() == n
    assert "checkpoint" not in str(statuses._jdf.queryExecution().optimizedPlan().toString()).lower()
    leaves = statuses._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("|")
    assert leaves.count("LogicalRDD") <= 1  # the given proofs


def test_untouched_outbox_rows_and_tickets_keep_what_they_have(spark):
    outbox = spark.createDataFrame([(1, "PUBLISHED", 0, 3, 5, 77, None), (2, "FAILED", 3, 3, 5, None, "old"), (3, "PENDING", 0, 3, 5, None, "old")],
                                   "outbox_id long, status string, retry_count int, max_retries int, available_epoch long, published_epoch long, last_error string")
    after = {r.outbox_id: r for r in reports.relay_result(outbox, spark.createDataFrame([(3, True, None)], "outbox_id long, ok boolean, error string"), 9).collect()}
    assert after[1].published_epoch == 77 and after[2].last_error == "old" and after[3].published_epoch == 9
    tickets = spark.createDataFrame([("t", "RESOLVED", "amy", 4)], "ticket_id string, status string, resolved_by string, resolved_epoch long")
    moves = spark.createDataFrame([("t", "OPEN", "bob", 8)], "ticket_id string, new_status string, moved_by string, moved_epoch long")
    for some in (moves, moves.limit(0)):
        row = exceptions.move_tickets(tickets, some).first()
        assert (row.resolved_by, row.resolved_epoch, row.status) == ("amy", 4, "RESOLVED")


def test_the_gate_fails_closed(spark):
    rows = spark.createDataFrame([(None, 0.9, True), ("invoice", None, True), ("invoice", 0.9, None), ("invoice", 0.9, True)],
                                 "label string, confidence double, anchor boolean")
    gate = labels.document_gate(F.lit(10), F.lit("application/pdf"), F.lit(".pdf"), F.col("label"), F.col("confidence"), F.col("anchor"))
    assert [r[0] for r in rows.select(gate).collect()] == ["INVALID_DOCUMENT_CLASSIFICATION"] * 3 + [None]


def test_kinds_of_completed_events(spark):
    good = {"vendor_code": "V", "matched_invoices": ["I"], "bank_utr_number": "U", "total_reconciled_amount": "5.00"}
    changes = [{}, {"vendor_code": 5}, {"bank_utr_number": 5}, {"matched_invoices": [5]}, {"debit_amount": None}, {"total_reconciled_amount": 5.25},
               {"debit_amount": "4.00"}, {"total_reconciled_amount": True}]
    rows = [(i, json.dumps({"id": f"e{i}", "source": "s", "data": good | c})) for i, c in enumerate(changes)] + [(8, "no json"), (9, None)]
    got = {r.i: r.error_code for r in posting.parse_completed(spark.createDataFrame(rows, "i int, value string")).collect()}
    bad = "MALFORMED_PAYLOAD"
    assert got == {0: None, 1: bad, 2: bad, 3: bad, 4: bad, 5: None, 6: "ORPHANED_DEBIT_CREDIT_MISMATCH", 7: "INVALID_PAISE_CASTING", 8: bad, 9: bad}


def test_tickets_of_events_without_id_stay_apart(spark):
    events = spark.createDataFrame([('{"data":{"vendor_code":"A"}}',), ('{"data":{"vendor_code":"B"}}',), ('{"data":{"vendor_code":"B"}}',)], "value string")
    none = spark.createDataFrame([], "event_id string")
    assert exceptions.new_tickets(exceptions.tickets_from_dlq(events), none).count() == 2


def test_large_keys_stay_apart(spark, tmp_path):
    spark.createDataFrame([(123_456_789, 1_234_567), (123_456_788, 1_234_568)], "o_orderkey long, o_custkey long").selectExpr(
        "*", "cast(1000 AS double) AS o_totalprice", "'O' AS o_orderstatus", "date'2020-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    rows = Fixtures(spark, str(tmp_path)).invoices().collect()
    assert {r.vendor_code for r in rows} == {"VEND_1234567", "VEND_1234568"} and {r.invoice_number for r in rows} == {"INV-123456789", "INV-123456788"}
