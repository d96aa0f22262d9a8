"""Invoice document: parsing, required fields, arithmetic checks, and declarative table rules.

Numbers are read as the text they were written as. Whether one was a float (not acceptable for money), a
decimal string or NULL rather than absent is looked up in a VARIANT parse, which only documents whose text
shows a fraction, an exponent or a null in such a field pay for.

Lines and summaries of whole numbers of up to nine digits that add up are passed by integer arithmetic. All others go
through the exact decimal checks, which alone make messages.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTY = ("struct<legal_name:string,gstin:string,pan:string,address:string,state_code:string,state_name:string,"
         "phone:string,email:string>")
LINE_NUMBERS = ("quantity", "unit_price_paise", "taxable_value_paise", "gst_rate", "igst_paise", "cgst_paise",
                "sgst_paise", "total_paise")
SUMMARY_NUMBERS = ("subtotal_paise", "total_tax_paise", "total_igst_paise", "total_cgst_paise", "total_sgst_paise",
                   "tds_deduction_paise", "other_charges_paise", "discount_paise", "rounding_adjustment_paise",
                   "grand_total_paise")


def _parts(number: str) -> dict[str, str]:
    return {
        "metadata": "map<string,string>", "supplier_details": PARTY, "buyer_details": PARTY,
        "reference_data": "struct<invoice_number:string,document_type_code:string,po_number:string,grn_number:string,"
                          "document_date:string,due_date:string,irn:string>",
        "banking_details": "struct<bank_name:string,account_number:string,ifsc:string,upi_id:string,"
                           "account_number_masked:string>",
        "line_items": "array<struct<line_number:string,description:string,hsn_sac_code:string,unit:string,"
                      + ",".join(f"{n}:{number}" for n in LINE_NUMBERS) + ">>",
        "financial_summary": "struct<" + ",".join(f"{n}:{number}" for n in SUMMARY_NUMBERS) + ">"}


def _schema(number: str, parts: Sequence[str] | None = None) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in _parts(number).items() if parts is None or name in parts)


NUMBER_PARTS = ("line_items", "financial_summary")
PARTY_PARTS = ("supplier_details", "buyer_details", "banking_details")
KIND_SCHEMA = _schema("variant", NUMBER_PARTS)
# One sign to begin with: tried at every place of a text, two alternatives took most of the time of an extraction.
SUSPECT_NUMBER = r'"(?::\s*+(?:null|-?[0-9]++[.eE])|\s++:)'

# Fields a document must carry.
REQUIRED_SUMMARY_NUMBERS = ("subtotal_paise", "total_tax_paise", "grand_total_paise")
CHECKED_LINE_NUMBERS = ("quantity", "unit_price_paise", "taxable_value_paise", "igst_paise", "cgst_paise",
                        "sgst_paise", "total_paise")
SUMMED_LINE_NUMBERS = ("taxable_value_paise", "igst_paise", "cgst_paise", "sgst_paise")

# States and the default document type.
VALIDATED, FLAGGED, FAILED = "VALIDATED", "EXCEPTION_FLAGGED", "FAILED"
DEFAULT_DOCUMENT_TYPE = "INV"
NO_LINES = "No line items found in invoice"


def unfence(raw: Column) -> Column:
    """Text without a Markdown fence: drop the first line when it opens one, and the closing mark."""
    text = F.trim(raw)
    body = F.regexp_replace(F.regexp_replace(text, r"\A```[^\n]*\n", ""), r"```\s*\z", "")
    return F.when(text.startswith("```"), F.trim(body)).otherwise(text)


def with_document(df: DataFrame, text_column: str = "raw_text", out: str = "doc", parts: Sequence[str] | None = None) -> DataFrame:
    """Adds ``struct(body, floats, nulls, plain)`` of the document text, NULL when it is no JSON object.

    ``parts`` names the parts of the body that are read, all by default; the text is checked as JSON in any case.
    ``plain`` says that numbers can be read as integers: none is a float or null, no text has escapes or control signs.
    ``floats`` and ``nulls`` name the number fields written as floats or as null: for each line and, last,
    for the summary. They are NULL for a document without any. The document comes out of ``explode``: a later
    filter on it is then evaluated after parsing, and is not pushed below and parsed once more per use.
    """
    text, body = F.col("__text"), F.col("__body")
    kinds = F.from_json(text, KIND_SCHEMA, {"mode": "PERMISSIVE"})

    def named(test):
        def of(x: Column, fields) -> Column:
            return F.array_compact(F.array(*[F.when(~x[n].isNull() & test(x[n]), F.lit(n)) for n in fields]))
        return F.when(F.col("__suspect"), F.array_append(
            F.transform(F.coalesce(kinds["line_items"], F.array()), lambda x: of(x, LINE_NUMBERS)),
            of(kinds["financial_summary"], SUMMARY_NUMBERS)))

    def float_kind(v: Column) -> Column:
        return F.coalesce(F.schema_of_variant(v).rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.lit(False))

    parsed = F.when(text.startswith("{") & body.isNotNull(), F.struct(
        body.alias("body"), named(float_kind).alias("floats"), named(F.is_variant_null).alias("nulls"),
        (~F.col("__suspect") & ~text.contains("\\") & ~text.contains("\x7f")).alias("plain")))
    numbers = parts is None or any(name in parts for name in NUMBER_PARTS)
    return (df.withColumn("__text", unfence(F.col(text_column)))
            .withColumn("__body", F.from_json(text, _schema("string", parts), {"mode": "PERMISSIVE"}))
            .withColumn("__suspect", text.rlike(SUSPECT_NUMBER) if numbers else F.lit(False))
            .select(*df.columns, F.explode(F.array(parsed)).alias(out)))


def _listed(names: Column, position: Column, field: str) -> Column:
    """Whether ``field`` is in the name list at ``position``."""
    return F.coalesce(F.array_contains(F.get(names, position), field), F.lit(False))


def _amount(text: Column, kind: str = "decimal(20,4)") -> Column:
    """Exact value; a missing field counts as 0, anything unreadable is NULL."""
    return F.when(text.isNull(), F.lit(0).cast(kind)).otherwise(text.try_cast(kind))


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit("0"))


def _whole(text: Column) -> Column:
    """Value of a whole number of a ``plain`` document; a missing field counts as 0, all else is NULL."""
    return _text(text).try_cast("int").cast("bigint")


def _clean_line(x: Column) -> Column:
    """Whether the sums of a line of whole numbers hold; NULL where other numbers need the exact check."""
    taxable = _whole(x["taxable_value_paise"])
    return (_whole(x["unit_price_paise"]) * _whole(x["quantity"]) == taxable) & (
        taxable + _whole(x["igst_paise"]) + _whole(x["cgst_paise"]) + _whole(x["sgst_paise"]) == _whole(x["total_paise"]))


def _clean_summary(doc: Column) -> Column:
    """Whether all sums of a summary of whole numbers hold; NULL where other numbers need the exact check."""
    lines = doc["body"]["line_items"]
    s = {n: _whole(doc["body"]["financial_summary"][n]) for n in SUMMARY_NUMBERS}

    def total(*fields: str) -> Column:
        def add(acc: Column, x: Column) -> Column:
            for f in fields:
                acc = acc + _whole(x[f])
            return acc
        return F.aggregate(lines, F.lit(0).cast("bigint"), add)

    return ((s["tds_deduction_paise"] >= 0) & ((s["tds_deduction_paise"] <= s["subtotal_paise"]) | (s["subtotal_paise"] <= 0))
            & (s["total_igst_paise"] + s["total_cgst_paise"] + s["total_sgst_paise"] == s["total_tax_paise"])
            & (s["subtotal_paise"] + s["total_tax_paise"] - s["discount_paise"] + s["other_charges_paise"]
               + s["rounding_adjustment_paise"] == s["grand_total_paise"])
            & (total("taxable_value_paise") == s["subtotal_paise"])
            & (total("igst_paise", "cgst_paise", "sgst_paise") == s["total_tax_paise"]))


def _plain(amount: Column) -> Column:
    """Digits of a decimal without trailing zeros after the point."""
    return F.regexp_replace(F.regexp_replace(amount.cast("string"), r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")


def paise(text: Column, is_float: Column) -> Column:
    """Paise as the tables store them: whole numbers and whole-number strings as they are, floats cut off."""
    cut = text.try_cast("decimal(38,6)")
    return (F.when(text.isNull(), F.lit(0).cast("bigint"))
            .when(is_float, (F.signum(cut) * F.floor(F.abs(cut))).cast("bigint"))
            .when(text.rlike(r"\A\s*[+-]?[0-9]+\s*\z"), text.try_cast("bigint")))


def line_errors(doc: Column) -> Column:
    """One message per failed sum of a line; a float or unreadable amount is the only message of its line."""
    line_items = doc["body"]["line_items"]

    def of_line(x: Column, i: Column) -> Column:
        label = F.concat(F.lit("Line "), F.coalesce(x["line_number"], F.lit("?")), F.lit(": "))
        bad = F.array_compact(F.array(*[
            F.when(_listed(doc["nulls"], i, n), F.lit("null"))
            .when(_listed(doc["floats"], i, n) | _amount(x[n]).isNull(), x[n]) for n in CHECKED_LINE_NUMBERS]))
        want = F.round(_amount(x["unit_price_paise"], "decimal(19,4)") * _amount(x["quantity"], "decimal(18,6)"), 0)
        total = (_amount(x["taxable_value_paise"]) + _amount(x["igst_paise"]) + _amount(x["cgst_paise"])
                 + _amount(x["sgst_paise"]))
        taxable_error = F.when(want != _amount(x["taxable_value_paise"]), F.concat(
            label, F.lit("taxable_value_paise "), _text(x["taxable_value_paise"]), F.lit(" != unit_price("),
            _text(x["unit_price_paise"]), F.lit(") x qty("), _text(x["quantity"]), F.lit(") = "), _plain(want)))
        total_error = F.when(total != _amount(x["total_paise"]), F.concat(
            label, F.lit("total_paise "), _text(x["total_paise"]), F.lit(" != taxable("),
            _text(x["taxable_value_paise"]), F.lit(") + igst("), _text(x["igst_paise"]), F.lit(") + cgst("),
            _text(x["cgst_paise"]), F.lit(") + sgst("), _text(x["sgst_paise"]), F.lit(") = "), _plain(total)))
        return F.when(doc["plain"] & _clean_line(x), F.expr("cast(array() AS array<string>)"))\
            .when(F.size(bad) > 0, F.array(F.concat(label, F.lit("Invalid decimal value - "), bad[0])))\
            .otherwise(F.array_compact(F.array(taxable_error, total_error)))

    return F.flatten(F.transform(line_items, of_line))


def _line_sum(line_items: Column, *fields: str) -> Column:
    zero = F.lit(0).cast("decimal(38,4)")

    def add(acc: Column, x: Column) -> Column:
        for f in fields:
            acc = acc + F.coalesce(_amount(x[f]), F.lit(0))
        return acc.cast("decimal(38,4)")

    return F.aggregate(line_items, zero, add)


def summary_errors(doc: Column) -> Column:
    """Messages of the summary sums against the lines and against each other."""
    summary, line_items = doc["body"]["financial_summary"], doc["body"]["line_items"]
    last = F.size(line_items)
    bad = F.array_compact(F.array(*[
        F.when(_listed(doc["nulls"], last, n), F.lit(n + " null"))
        .when(_listed(doc["floats"], last, n) | _amount(summary[n]).isNull(), F.concat(F.lit(n + " "), summary[n]))
        for n in SUMMARY_NUMBERS]))
    # An amount of a line that cannot be summed stops the summary check in the same way.
    bad_lines = F.filter(F.transform(line_items, lambda x, i: F.array_contains(F.array(*[
        _listed(doc["nulls"], i, n) | _listed(doc["floats"], i, n) | _amount(x[n]).isNull() for n in SUMMED_LINE_NUMBERS]), True)),
        lambda b: b)

    def s(name: str) -> Column:
        return _amount(summary[name])

    def t(name: str) -> Column:
        return _text(summary[name])

    taxable = _line_sum(line_items, "taxable_value_paise")
    tax = _line_sum(line_items, "igst_paise", "cgst_paise", "sgst_paise")
    split = s("total_igst_paise") + s("total_cgst_paise") + s("total_sgst_paise")
    grand = (s("subtotal_paise") + s("total_tax_paise") - s("discount_paise") + s("other_charges_paise")
             + s("rounding_adjustment_paise"))
    found = F.array_compact(F.array(
        F.when(taxable != s("subtotal_paise"), F.concat(
            F.lit("subtotal_paise "), t("subtotal_paise"), F.lit(" != sum of line item taxable values "),
            _plain(taxable))),
        F.when(tax != s("total_tax_paise"), F.concat(
            F.lit("total_tax_paise "), t("total_tax_paise"), F.lit(" != sum of line item GST "), _plain(tax))),
        F.when(split != s("total_tax_paise"), F.concat(
            F.lit("GST split "), _plain(split), F.lit(" (igst+cgst+sgst) != total_tax_paise "), t("total_tax_paise"))),
        F.when(grand != s("grand_total_paise"), F.concat(
            F.lit("grand_total_paise "), t("grand_total_paise"), F.lit(" != subtotal("), t("subtotal_paise"),
            F.lit(") + tax("), t("total_tax_paise"), F.lit(") - discount("), t("discount_paise"), F.lit(") + other("),
            t("other_charges_paise"), F.lit(") + rounding("), t("rounding_adjustment_paise"), F.lit(") = "),
            _plain(grand))),
        F.when(s("tds_deduction_paise") < 0, F.concat(F.lit("tds_deduction_paise is negative: "),
                                                      t("tds_deduction_paise"))),
        F.when((s("tds_deduction_paise") > s("subtotal_paise")) & (s("subtotal_paise") > 0), F.concat(
            F.lit("tds_deduction_paise "), t("tds_deduction_paise"), F.lit(" exceeds subtotal "),
            t("subtotal_paise")))))
    return F.when(doc["plain"] & _clean_summary(doc), F.expr("cast(array() AS array<string>)")).when(
        (F.size(bad) > 0) | (F.size(bad_lines) > 0), F.array(F.concat(
        F.lit("Financial summary validation error: "), F.coalesce(F.get(bad, F.lit(0)), F.lit("line item amount"))))).otherwise(found)


def checksum_errors(doc: Column) -> Column:
    """All arithmetic messages of a document; without lines that is the one message."""
    lines = doc["body"]["line_items"]
    none = lines.isNull() | (F.size(lines) == 0)
    return F.when(none, F.array(F.lit(NO_LINES))).otherwise(F.concat(line_errors(doc), summary_errors(doc)))


def _known(values: Sequence[Column]) -> Column:
    """Whether none of these whole numbers is NULL."""
    return reduce(lambda a, b: a + b, values).isNotNull()


def _well_formed(body: Column) -> Column:
    """Whether a ``plain`` document has all required fields, with numbers that :func:`_whole` reads; else each is looked at."""
    ref, summary = body["reference_data"], body["financial_summary"]
    given = [body["supplier_details"]["legal_name"], body["buyer_details"], ref["invoice_number"], ref["document_type_code"],
             ref["document_date"].try_cast("date"), body["banking_details"], body["line_items"],
             *[summary[n] for n in REQUIRED_SUMMARY_NUMBERS]]

    def line_ok(x: Column) -> Column:
        present = [x[n].try_cast("int").cast("bigint") for n in (
            "line_number", "quantity", "gst_rate", "unit_price_paise", "taxable_value_paise", "total_paise")]
        return x["description"].isNotNull() & x["unit"].isNotNull() & _known(
            present + [_whole(x[n]) for n in ("igst_paise", "cgst_paise", "sgst_paise")])

    return (reduce(lambda a, b: a & b, [g.isNotNull() for g in given])
            & (ref["due_date"].isNull() | ref["due_date"].try_cast("date").isNotNull())
            & _known([_whole(summary[n]) for n in SUMMARY_NUMBERS]) & F.forall(body["line_items"], line_ok))


def schema_errors(doc: Column) -> Column:
    """Required fields that are missing or of the wrong kind."""
    def need(ok: Column, path: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(path))

    body = doc["body"]
    ref, lines, summary = body["reference_data"], body["line_items"], body["financial_summary"]
    last = F.coalesce(F.size(lines), F.lit(0))

    def whole(x: Column, i: Column, n: str) -> Column:
        return (doc["plain"] & _whole(x[n]).isNotNull()) | (
            paise(x[n], _listed(doc["floats"], i, n)).isNotNull() & ~_listed(doc["nulls"], i, n))

    def line_ok(x: Column, i: Column) -> Column:
        ok = x["line_number"].try_cast("int").isNotNull() & x["description"].isNotNull() & x["unit"].isNotNull()
        for n in ("quantity", "gst_rate"):
            ok = ok & (x[n].try_cast("int").isNotNull() | x[n].try_cast("decimal(18,6)").isNotNull())
        for n in ("unit_price_paise", "taxable_value_paise", "total_paise"):
            ok = ok & x[n].isNotNull() & whole(x, i, n)
        for n in ("igst_paise", "cgst_paise", "sgst_paise"):
            ok = ok & whole(x, i, n)
        return F.coalesce(ok, F.lit(False))

    found = F.array_compact(F.array(
        need(body["supplier_details"]["legal_name"].isNotNull(), "supplier_details.legal_name"),
        need(body["buyer_details"].isNotNull(), "buyer_details"),
        need(ref["invoice_number"].isNotNull(), "reference_data.invoice_number"),
        need(ref["document_type_code"].isNotNull(), "reference_data.document_type_code"),
        need(ref["document_date"].try_cast("date").isNotNull(), "reference_data.document_date"),
        need(ref["due_date"].isNull() | ref["due_date"].try_cast("date").isNotNull(), "reference_data.due_date"),
        need(body["banking_details"].isNotNull(), "banking_details"),
        need(lines.isNotNull(), "line_items"),
        need(lines.isNull() | F.forall(F.transform(lines, line_ok), lambda ok: ok), "line_items[]"),
        *[need(summary[n].isNotNull() & whole(summary, last, n), f"financial_summary.{n}")
          for n in REQUIRED_SUMMARY_NUMBERS],
        *[need(whole(summary, last, n), f"financial_summary.{n}")
          for n in SUMMARY_NUMBERS if n not in REQUIRED_SUMMARY_NUMBERS]))
    return (F.when(doc.isNull(), F.array(F.lit("not a JSON object")))
            .when(doc["plain"] & _well_formed(body), F.expr("cast(array() AS array<string>)")).otherwise(found))


def extraction_status(checksum: Column, schema: Column) -> Column:
    """A document that breaks the schema failed; otherwise wrong sums only flag it."""
    return (F.when(F.size(schema) > 0, FAILED).when(F.size(checksum) == 0, VALIDATED).otherwise(FLAGGED))


def flatten_document(doc: Column) -> list[Column]:
    """Searchable columns of a document."""
    body = doc["body"]
    ref, summary, sup, buy = (body[n] for n in ("reference_data", "financial_summary", "supplier_details",
                                                "buyer_details"))
    last = F.coalesce(F.size(body["line_items"]), F.lit(0))

    def total(name: str) -> Column:
        return F.coalesce(paise(summary[name], _listed(doc["floats"], last, name)), F.lit(0)).alias(name)

    return [
        ref["invoice_number"].alias("invoice_number"),
        F.coalesce(ref["document_type_code"], F.lit(DEFAULT_DOCUMENT_TYPE)).alias("document_type_code"),
        ref["po_number"].alias("po_number"),
        ref["document_date"].try_cast("date").alias("document_date"),
        ref["due_date"].try_cast("date").alias("due_date"),
        sup["legal_name"].alias("supplier_legal_name"), sup["gstin"].alias("supplier_gstin"),
        sup["pan"].alias("supplier_pan"),
        buy["legal_name"].alias("buyer_legal_name"), buy["gstin"].alias("buyer_gstin"),
        F.lit("INR").alias("currency_code"),
        total("grand_total_paise"), total("tds_deduction_paise")]


# -- rules on tables ------------------------------------------------------------------------------

# The checks each table carries. As in SQL, a check only fails when it is false, not when NULL.
TABLE_RULES: dict[str, dict[str, str]] = {
    "extracted_invoices": {
        "grand_total_non_negative": "grand_total_paise >= 0",
        "tds_non_negative": "tds_deduction_paise >= 0",
        "status_known": "processing_status IN ('PENDING', 'VALIDATED', 'EXCEPTION_FLAGGED', 'PUBLISHED')",
    },
    "settlements": {
        "amount_non_negative": "amount_paise >= 0",
        "fees_non_negative": "fees_paise >= 0",
        "tax_non_negative": "tax_paise >= 0",
    },
    "bank_transactions": {
        "amount_non_negative": "amount_paise >= 0",
        "balance_non_negative": "closing_balance_paise >= 0",
        "type_known": "transaction_type IN ('CREDIT', 'DEBIT')",
    },
    "ledger_entries": {
        "amount_non_negative": "amount_paise >= 0",
        "type_known": "entry_type IN ('DEBIT', 'CREDIT')",
        "cleared_not_empty": "size(cleared_invoice_ids) > 0",
    },
    "exception_tickets": {
        "flagged_not_empty": "size(flagged_invoice_ids) > 0",
        "status_known": "status IN ('OPEN', 'IN_REVIEW', 'RESOLVED', 'CLOSED')",
    },
}


def violations(df: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """One row per broken rule: (key, rule)."""
    broken = F.array_compact(F.array(*[F.when(~F.expr(cond), F.lit(name)) for name, cond in rules.items()]))
    return df.select(F.col(key).alias("key"), F.explode(broken).alias("rule"))
