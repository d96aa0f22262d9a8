"""Reconciliation tables derived from the order/line/event tables, by integer arithmetic only.

``k`` is the order key. Each method returns a lazy DataFrame, so a query reads only the columns it uses.
Keys per vendor are positions in key order; they are computed bucket-wise, never one vendor per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.scale import ordinal, written

KEY_BUCKET = 4096


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._named: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- invoices ---------------------------------------------------------------------------------

    def invoices(self) -> DataFrame:
        """One invoice per order, without the supplier name (which needs the lines)."""
        return self._shaped(self.table("orders"))

    @staticmethod
    def _shaped(orders: DataFrame, *more: str) -> DataFrame:
        return orders.selectExpr(
            "o_orderkey AS k",
            "o_custkey AS custkey",
            "cast(o_orderkey AS string) AS document_id",
            "concat('VEND_', lpad(cast(o_custkey AS string), greatest(6, length(cast(o_custkey AS string))), '0')) AS vendor_code",
            "concat('INV-', lpad(cast(o_orderkey AS string), greatest(8, length(cast(o_orderkey AS string))), '0')) AS invoice_number",
            "cast(o_orderdate AS date) AS document_date",
            "cast(round(o_totalprice * 100) AS bigint) AS grand_total_paise",
            "cast(round(o_totalprice * 100) AS bigint) div 50 AS tds_deduction_paise",
            "CASE WHEN o_orderstatus = 'P' THEN 'EXCEPTION_FLAGGED' ELSE 'VALIDATED' END AS processing_status",
            "(cast(floor(o_totalprice / 50000) AS bigint) + 1) * 1000000 AS coarse_net_paise",
            *more)

    def suppliers(self) -> DataFrame:
        """Supplier name per order: the part with the smallest key among its lines."""
        first_part = self.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
            F.min("l_partkey").alias("p_partkey"))
        return first_part.join(self.table("part").select("p_partkey", "p_name"), "p_partkey").select(
            "k", F.concat("p_name", F.lit(" Pvt Ltd")).alias("supplier_legal_name"))

    def share_names(self) -> None:
        """Write the named invoices to files, for queries that read them for invoices, settlements and bank lines."""
        if self._named is None:
            self._named = written(self.invoices_named())

    def invoices_named(self) -> DataFrame:
        if self._named is not None:
            return self._named
        # Orders meet their names as they are; the longer columns of an invoice are made behind the join.
        orders = self.table("orders").join(self.suppliers().withColumnRenamed("k", "o_orderkey"), "o_orderkey", "left")
        return self._shaped(orders, "coalesce(supplier_legal_name, 'unknown Pvt Ltd') AS supplier_legal_name")

    # -- feeds ------------------------------------------------------------------------------------

    @staticmethod
    def _utr() -> Column:
        return F.expr("CASE WHEN k % 13 <> 0 THEN cast(300000000001 + k AS string) END")

    def settlements(self, named: bool = False, older: bool = True) -> DataFrame:
        """Gateway payouts; with ``older``, every nineteenth also has a version ingested a day before."""
        base = (self.invoices_named() if named else self.invoices()).filter("k % 5 <> 0")
        narration = ("""CASE WHEN k % 3 = 0 THEN concat('IMPS/', cast(300000000001 + k AS string),
                     '/HDFC/', replace(replace(upper(supplier_legal_name), 'WIDGET', 'WIDGIT'), 'PLATE', 'PLAITE'))
                     ELSE concat(upper(supplier_legal_name), ' - PAYOUT ', invoice_number) END"""
                     if named else "cast(NULL AS string)")
        current = base.withColumn("utr", self._utr()).selectExpr(
            "k", "concat('pout_', k) AS payout_id", "concat('fa_', k) AS fund_account_id",
            "grand_total_paise - tds_deduction_paise AS amount_paise", "'INR' AS currency",
            "CASE WHEN k % 17 = 0 THEN 'failed' ELSE 'processed' END AS status", "utr",
            "invoice_number AS reference_id", f"{narration} AS narration",
            "(grand_total_paise - tds_deduction_paise) div 100 AS fees_paise",
            "(grand_total_paise - tds_deduction_paise) div 100 * 18 div 100 AS tax_paise",
            "'IMPS' AS mode", "'payout' AS purpose", "vendor_code",
            "cast(unix_date(document_date) AS bigint) * 86400 AS event_created_at_epoch",
            "cast(unix_date(document_date) AS bigint) * 86400 + 3 * 86400 + k % 86400 AS ingested_epoch")
        if not older:
            return current
        old = current.filter("k % 19 = 0").selectExpr(
            "*", "concat(payout_id, '_old') AS old_id", "ingested_epoch - 86400 AS old_epoch").drop(
            "payout_id", "ingested_epoch").withColumnsRenamed(
            {"old_id": "payout_id", "old_epoch": "ingested_epoch"})
        return current.unionByName(old)

    def bank(self, named: bool = False, coarse: bool = False) -> DataFrame:
        """Statement lines, one per current settlement."""
        base = (self.invoices_named() if named else self.invoices()).filter("k % 5 <> 0")
        amount = "coarse_net_paise" if coarse else \
            "grand_total_paise - tds_deduction_paise - CASE WHEN k % 29 = 0 THEN 100 ELSE 0 END"
        narration = ("concat('NEFT/', coalesce(utr_number, '0'), '/HDFC/', upper(supplier_legal_name))"
                     if named else "concat('NEFT/', coalesce(utr_number, '0'), '/HDFC/')")
        return base.withColumn("utr_number", self._utr()).selectExpr(
            "k", "concat('btx_', k) AS transaction_id",
            "date_add(document_date, cast(2 + k % 12 AS int)) AS transaction_date",
            f"{narration} AS narration", "utr_number",
            "CASE WHEN k % 23 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS transaction_type",
            f"{amount} AS amount_paise", "vendor_code")

    def reconciliations(self) -> DataFrame:
        return self.invoices().filter("processing_status = 'VALIDATED' AND k % 11 = 0").withColumn(
            "utr_number", self._utr()).selectExpr(
            "k", "concat('evt_', k) AS idempotency_event_id", "document_id", "invoice_number", "vendor_code",
            "utr_number", "concat('pout_', k) AS payout_id",
            "grand_total_paise - tds_deduction_paise AS net_settled_amount_paise",
            "cast(unix_date(document_date) AS bigint) * 86400 + 20 * 86400 AS reconciled_epoch")

    # -- batches ----------------------------------------------------------------------------------

    @staticmethod
    def _batch_id() -> Column:
        return F.expr("concat('00000000-0000-4000-800', k % 3, '-', lpad(cast(custkey AS string), greatest(12, length(cast(custkey AS string))), '0'))")

    def items(self) -> DataFrame:
        """Batch items: three batches per vendor, rows numbered from 0 in key order."""
        rows = self.invoices().withColumn("batch_id", self._batch_id())
        rows = ordinal(rows, ["batch_id"], F.expr(f"k div {KEY_BUCKET}"), [F.col("k")], "position")
        return rows.selectExpr(
            "k", "batch_id", "vendor_code",
            "CASE WHEN k % 31 <> 0 THEN document_id END AS document_id",
            "cast(position - 1 AS bigint) AS row_number",
            "CASE WHEN k % 31 <> 0 THEN invoice_number END AS invoice_number",
            "CASE WHEN k % 31 = 0 THEN 'FAILED' ELSE processing_status END AS status",
            "CASE WHEN k % 31 = 0 THEN concat('extraction failed for ', invoice_number) END AS error_message")

    def batches(self) -> DataFrame:
        return self.invoices().withColumn("batch_id", self._batch_id()).groupBy(
            "batch_id", "vendor_code", "custkey").agg(
            F.count(F.lit(1)).alias("total_invoices"),
            F.count_if(F.expr("k % 31 <> 0")).alias("processed_count"),
            F.count_if(F.expr("k % 31 = 0")).alias("failed_count"),
            F.min(F.unix_date("document_date")).cast("bigint").alias("lo"),
            F.max(F.unix_date("document_date")).cast("bigint").alias("hi")).selectExpr(
            "batch_id", "vendor_code", "custkey", "total_invoices", "processed_count", "failed_count",
            "CASE WHEN custkey % 7 <> 0 THEN 'COMPLETED' ELSE 'PENDING' END AS status",
            "(lo - 1) * 86400 AS created_epoch",
            "CASE WHEN custkey % 7 <> 0 AND custkey % 9 <> 0 THEN (hi + 1) * 86400 END AS completed_epoch")

    def runs(self) -> DataFrame:
        """Run rows for two thirds of the batches, in every state."""
        return self.batches().filter("custkey % 3 <> 0").selectExpr(
            "batch_id", "vendor_code", "'BATCH' AS run_type",
            "element_at(array('SEALED', 'RUNNING', 'COMPLETED', 'PARTIAL', 'RUNNING'), cast(custkey % 5 + 1 AS int))"
            " AS status",
            "total_invoices AS total_extracted", "processed_count AS matched_count",
            "failed_count AS exception_count", "created_epoch",
            "CASE WHEN custkey % 5 <> 0 THEN created_epoch + custkey % 4 * 600 END AS started_epoch")

    def tickets(self) -> DataFrame:
        """Tickets for every 29th open invoice; every 58th has a second, later one with another reason."""
        base = self.open_invoices().filter("k % 29 = 0")

        def ticket(rows: DataFrame, tag: str, shift: int, days: int) -> DataFrame:
            return rows.selectExpr(
                "k", f"concat('tkt_', k, '{tag}') AS ticket_id", "vendor_code",
                "array(invoice_number) AS flagged_invoice_ids",
                "element_at(array('NO_MATCH', 'AMBIGUOUS_COLLISION', 'ENTITY_MISMATCH', 'NEGATIVE_NET_SETTLEMENT',"
                f" 'REASON_UNSPECIFIED'), cast((k + {shift}) % 5 + 1 AS int)) AS exception_reason",
                "CASE WHEN k % 4 > 1 THEN concat('clerk_', k % 7) END AS resolved_by",
                "CASE WHEN k % 4 > 1 THEN k + 9 END AS resolved_epoch",
                "element_at(array('OPEN', 'IN_REVIEW', 'RESOLVED', 'CLOSED'), cast(k % 4 + 1 AS int)) AS status",
                f"cast(unix_date(document_date) AS bigint) * 86400 + {days} * 86400 AS created_epoch")

        return ticket(base, "a", 0, 10).unionByName(ticket(base.filter("k % 58 = 0"), "b", 2, 20))

    def open_invoices(self, named: bool = False) -> DataFrame:
        from ledgerloom.operators.reads import open_invoices
        return open_invoices(self.invoices_named() if named else self.invoices(), self.reconciliations())

    # -- documents --------------------------------------------------------------------------------

    def lines(self) -> DataFrame:
        """Invoice lines; the total is one paisa off for every tenth part."""
        from pyspark.sql import Window
        every = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        numbered = self.table("lineitem").withColumn(
            "line_number", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*every)))
        return numbered.selectExpr(
            "l_orderkey AS k", "line_number", "l_partkey",
            "cast(l_quantity AS bigint) AS quantity",
            "cast(round(l_extendedprice * 100) AS bigint) div cast(l_quantity AS bigint) AS unit_price_paise",
            "cast(round(l_tax * 100) AS bigint) AS gst_rate").selectExpr(
            "*", "unit_price_paise * quantity AS taxable_value_paise",
            "unit_price_paise * quantity * gst_rate div 100 AS igst_paise").selectExpr(
            "*", "taxable_value_paise + igst_paise + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS total_paise")

    def documents_json(self) -> DataFrame:
        """The extracted invoice as JSON text per order, with a Markdown fence around every third one.

        The subtotal is off by one for every seventh order, a required field is missing for every 37th and
        orders without lines have an empty list.
        """
        line = F.struct(
            "line_number", F.concat(F.lit("part "), F.col("l_partkey")).alias("description"), "quantity",
            F.lit("NOS").alias("unit"), "unit_price_paise", "taxable_value_paise", "gst_rate", "igst_paise",
            "total_paise")
        per_order = self.lines().groupBy("k").agg(
            F.array_sort(F.collect_list(line)).alias("line_items"),
            F.sum("taxable_value_paise").alias("subtotal"), F.sum("igst_paise").alias("tax"))
        rows = self.invoices_named().join(per_order, "k", "left")
        doc = F.to_json(F.struct(
            F.create_map(F.lit("source_file"), F.concat(F.lit("scan_"), F.col("k"))).alias("metadata"),
            F.struct(F.expr("CASE WHEN k % 37 <> 0 THEN supplier_legal_name END").alias("legal_name"),
                     F.expr("CASE WHEN k % 2 = 0 THEN concat('27', 'ABCDE', lpad(cast(k % 10000 AS string), 4, '0'),"
                            " 'F1Z5') END").alias("gstin"),
                     F.expr("concat('ABCDE', lpad(cast(k % 10000 AS string), 4, '0'), 'F')").alias("pan")
                     ).alias("supplier_details"),
            F.struct(F.concat(F.lit("Buyer "), F.col("custkey")).alias("legal_name")).alias("buyer_details"),
            F.struct("invoice_number",
                     F.expr("CASE WHEN k % 6 = 0 THEN 'CRN' ELSE 'INV' END").alias("document_type_code"),
                     F.col("document_date").cast("string").alias("document_date")).alias("reference_data"),
            F.struct(F.lit("HDFC").alias("bank_name"),
                     F.expr("cast(50100000000000 + k AS string)").alias("account_number"),
                     F.expr("concat('HDFC0', lpad(cast(custkey AS string), greatest(6, length(cast(custkey AS string))), '0'))").alias("ifsc")
                     ).alias("banking_details"),
            F.coalesce("line_items", F.expr("array()").cast(
                "array<struct<line_number:int,description:string,quantity:bigint,unit:string,unit_price_paise:bigint,"
                "taxable_value_paise:bigint,gst_rate:bigint,igst_paise:bigint,total_paise:bigint>>")
            ).alias("line_items"),
            F.struct((F.coalesce("subtotal", F.lit(0)) + F.expr("CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END")
                      ).alias("subtotal_paise"),
                     F.coalesce("tax", F.lit(0)).alias("total_tax_paise"),
                     F.coalesce("tax", F.lit(0)).alias("total_igst_paise"),
                     F.expr("CASE WHEN k % 41 = 0 THEN -1 ELSE tds_deduction_paise END").alias("tds_deduction_paise"),
                     (F.coalesce("subtotal", F.lit(0)) + F.coalesce("tax", F.lit(0))).alias("grand_total_paise")
                     ).alias("financial_summary")))
        fenced = F.when(F.col("k") % 3 == 0, F.concat(F.lit("```json\n"), doc, F.lit("\n```"))).otherwise(doc)
        return rows.select("k", "vendor_code", "document_id", fenced.alias("raw_text"))

    # -- page text, personal data, telemetry ------------------------------------------------------

    def page_text(self) -> DataFrame:
        """Conversation turns as scanned pages, with invoice words put in front of some."""
        return self.table("conversations").selectExpr(
            "cast(conv_id AS string) AS batch_id", "turn AS page_index",
            "concat(CASE WHEN turn % 3 = 0 THEN concat('TAX INVOICE Invoice No: INV-', conv_id, '-', turn, ' ')"
            " ELSE '' END,"
            "CASE WHEN turn % 4 = 1 THEN concat('GSTIN 27ABCDE', lpad(cast((conv_id + turn) % 10000 AS string), 4, '0'),"
            " 'F1Z5 ') ELSE '' END,"
            "CASE WHEN turn % 5 = 2 THEN 'Grand Total 10 Authorized Signatory ' ELSE '' END,"
            "CASE WHEN turn % 7 = 4 THEN 'bank details ' ELSE '' END,"
            "CASE WHEN conv_id % 20 = 0 AND turn = 0 THEN 'cover sheet ' ELSE '' END, text) AS text")

    def pii_text(self) -> DataFrame:
        """Documents with identifiers appended: a tax number, a bank account or a bare amount, a bank code."""
        return self.table("documents").selectExpr(
            "doc_id",
            "concat(text,"
            "CASE WHEN doc_id % 2 = 0 THEN concat(' PAN ABCDE', lpad(cast(doc_id % 50 AS string), 4, '0'), 'F') ELSE '' END,"
            "CASE WHEN doc_id % 3 = 0 THEN concat(' account no ', 50100000000000 + doc_id % 40) ELSE '' END,"
            "CASE WHEN doc_id % 4 = 0 THEN concat(' IFSC HDFC0', lpad(cast(doc_id % 30 AS string), 6, '0')) ELSE '' END,"
            "CASE WHEN doc_id % 5 = 0 THEN concat(repeat(' filler', 14), ' amount ', 7000000000000 + doc_id) ELSE '' END)"
            " AS text")

    def telemetry(self) -> DataFrame:
        """Events as run telemetry; every tenth is delivered twice."""
        once = self.table("events").selectExpr(
            "event_id", "cast(user_id AS string) AS batch_id",
            "cast(event_id % 20 AS string) AS invoice", "unix_micros(cast(ts AS timestamp)) AS ts_us",
            "CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'deterministic'"
            " WHEN 'click' THEN 'tool_called' WHEN 'error' THEN 'agent' ELSE 'terminal' END AS stage",
            "CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'run_fuzzy_text_linker_tool'"
            " ELSE 'run_subset_sum_matching_tool' END"
            " WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'run_subset_sum_matching_tool -> NO_MATCH'"
            " ELSE 'run_subset_sum_matching_tool -> SUBSET_MATCHED' END ELSE event_type END AS detail",
            "CASE WHEN event_type = 'purchase' THEN element_at(array('LEDGER_COMMITTED', 'ALREADY_COMMITTED',"
            " 'EXCEPTION_ROUTED'), cast(event_id % 3 + 1 AS int)) END AS terminal_status")
        return once.unionByName(once.filter("event_id % 10 = 0"))
