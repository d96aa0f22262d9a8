"""Small per-row rules: routing, gates, states and wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.money import format_inr

# Limits of the document gate and of quality routing.
MAX_UPLOAD_MB = 10
MAX_BATCH_MB = 100
CLASSIFICATION_THRESHOLD = 0.80
BLUR_THRESHOLD = 100.0
OCR_CONFIDENCE_THRESHOLD = 70.0
ALLOWED_TYPES = {
    "application/pdf": (".pdf",),
    "image/jpeg": (".jpg", ".jpeg"),
    "image/png": (".png",),
}
ANCHOR_PATTERN = r"(?i)(invoice|tax|amount due|total|balance)"
ANCHOR_PAGES = 3

# Vendor record formats.
VENDOR_CODE_PATTERN = r"\A[A-Z0-9_-]{3,64}\z"
EMAIL_PATTERN = r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"

# Text caps.
ERROR_CAP = 500
SUBSET_MESSAGE_CAP = 200
TERMINAL_DETAIL_CAP = 240
ENGINE_MESSAGE_CAP = 300

CLASS_LABELS = ("invoice", "bank_statement", "other")


def document_gate(size: Column, mime: Column, extension: Column, label: Column, confidence: Column,
                  has_anchor: Column, max_mb: int = MAX_UPLOAD_MB) -> Column:
    """Error code of the first failed gate, NULL for an accepted file."""
    ext = F.lower(extension)
    types = F.create_map(*[x for m, es in ALLOWED_TYPES.items() for x in (F.lit(m), F.array(*map(F.lit, es)))])
    expected = F.try_element_at(types, mime)
    all_ext = [e for es in ALLOWED_TYPES.values() for e in es]
    wrong_type = expected.isNull() | F.coalesce(~ext.isin(*all_ext) | ~F.array_contains(expected, ext), F.lit(True))
    # What is not known fails the gate.
    wrong_class = F.coalesce((label != "invoice") | (confidence < CLASSIFICATION_THRESHOLD), F.lit(True))
    return (F.when(size > max_mb * 1024 * 1024, "FILE_TOO_LARGE")
            .when(wrong_type, "UNSUPPORTED_FILE_TYPE")
            .when(wrong_class, "INVALID_DOCUMENT_CLASSIFICATION")
            .when((ext == ".pdf") & ~F.coalesce(has_anchor, F.lit(False)), "INVALID_DOCUMENT_CLASSIFICATION"))


def has_anchor_word(text: Column) -> Column:
    return text.rlike(ANCHOR_PATTERN)


def quality_route(blur: Column, ocr_confidence: Column) -> Column:
    """``fast`` for a sharp page with confident text, else ``fallback``."""
    return F.when((blur >= BLUR_THRESHOLD) & (ocr_confidence >= OCR_CONFIDENCE_THRESHOLD), "fast").otherwise("fallback")


def softmax_label(logits: Column, labels: tuple[str, ...] = CLASS_LABELS) -> Column:
    """``struct(label, confidence)`` of the largest logit; the first one wins a tie."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x.cast("double") - top.cast("double")))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    names = F.array(*[F.lit(n) for n in labels])
    position = F.array_position(logits, top).cast("int")
    return F.struct(F.coalesce(F.get(names, position - 1), F.lit("unknown")).alias("label"),
                    (F.array_max(weights) / total).alias("confidence"))


def normalize_vendor_code(code: Column) -> Column:
    return F.upper(F.trim(code))


def clean_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def vendor_record_errors(code: Column, name: Column, email: Column) -> Column:
    """Names of the fields of a vendor record that stay invalid after cleaning."""
    return F.array_compact(F.array(
        F.when(~F.coalesce(normalize_vendor_code(code).rlike(VENDOR_CODE_PATTERN), F.lit(False)), "vendor_code"),
        F.when(F.coalesce(F.length(clean_name(name)), F.lit(0)) < 2, "vendor_name"),
        F.when(~F.coalesce(F.lower(F.trim(email)).rlike(EMAIL_PATTERN), F.lit(False)), "email")))


def row_state(utr: Column, reason: Column) -> Column:
    cleared = F.coalesce(utr, F.lit("")) != ""
    review = F.coalesce(reason, F.lit("")) != ""
    return F.when(cleared, "cleared").when(review, "review").otherwise("processing")


def shown_amount(state: Column, net_settled: Column, net: Column) -> Column:
    return F.when(state == "cleared", net_settled).otherwise(net)


def _has(text: Column, *parts: str) -> Column:
    hit = text.contains(parts[0])
    for p in parts[1:]:
        hit = hit | text.contains(p)
    return hit


# Sentences shown to people, with the invoice before, between or after the parts.
AMBIGUOUS_TEXT = ("Ambiguous settlement for ", " — routed to the Maker/Checker queue to prevent misallocation.")
SUPPLIER_TEXT = ("Supplier details for ", " could not be fully confirmed — parked for manual review.")
REVIEW_TEXT = (" requires manual review (", ").")
CLEARED_TEXT = ("Perfect match found — ", " cleared against Bank UTR ", " for ", ".")


def exception_text(reason: Column, invoice: Column) -> Column:
    r = F.upper(F.coalesce(reason, F.lit("")))
    return (F.when(_has(r, "NO_MATCH", "AMBIGUOUS", "COLLISION"), F.concat(
                F.lit(AMBIGUOUS_TEXT[0]), invoice, F.lit(AMBIGUOUS_TEXT[1])))
            .when(_has(r, "ENTITY", "ALIAS", "MISMATCH"), F.concat(
                F.lit(SUPPLIER_TEXT[0]), invoice, F.lit(SUPPLIER_TEXT[1])))
            .otherwise(F.concat(invoice, F.lit(REVIEW_TEXT[0]), reason, F.lit(REVIEW_TEXT[1]))))


def reason_tone(reason: Column) -> Column:
    r = F.upper(reason)
    return (F.when(_has(r, "NO_MATCH", "MISMATCH"), "danger").when(_has(r, "COLLISION", "ENTITY"), "pending")
            .otherwise("neutral"))


def status_tone(status: Column) -> Column:
    s = F.upper(F.coalesce(status, F.lit("")))
    return (F.when(_has(s, "COMPLETED", "LEDGER_COMMITTED") | (s == "RESOLVED"), "success")
            .when(_has(s, "RUNNING") | s.isin("IN_REVIEW", "SEALED", "PENDING"), "pending")
            .when(_has(s, "FAILED", "EXCEPTION") | s.isin("OPEN", "NO_MATCH"), "danger")
            .otherwise("neutral"))


def cleared_text(invoice: Column, utr: Column, paise: Column) -> Column:
    return F.concat(F.lit(CLEARED_TEXT[0]), invoice, F.lit(CLEARED_TEXT[1]), utr, F.lit(CLEARED_TEXT[2]),
                    format_inr(paise), F.lit(CLEARED_TEXT[3]))


def capped_error(text: Column) -> Column:
    return F.left(text, F.lit(ERROR_CAP))


def exception_reason(subset_status: Column, fuzzy_status: Column, waterfall_status: Column) -> Column:
    """Why an invoice goes to review; the first outcome that explains it."""
    return (F.when(subset_status == "NO_MATCH", "NO_MATCH")
            .when(subset_status == "AMBIGUOUS_COLLISION", "AMBIGUOUS_COLLISION")
            .when(fuzzy_status == "ENTITY_MISMATCH", "ENTITY_MISMATCH")
            .when(F.coalesce(waterfall_status, F.lit("")).isin("", "WATERFALL_CALCULATED"), "REASON_UNSPECIFIED")
            .otherwise(waterfall_status))
