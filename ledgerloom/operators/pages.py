"""Scanned pages to invoices: page signals, page groups, page text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.scale import previous_value, running_sum, written

# What a page is recognised by. Free text, so words and case are Unicode-aware.
INVOICE_WORD = r"(?iuU)\b(invoice|bill\s+to)\b"
INVOICE_NUMBER = r"(?iuU)(?:invoice|inv|bill)\s+(?:no|number|#|num)\s*[:.\-]?\s*([A-Z0-9][\w\-/]{2,30})"
TOTAL_BLOCK = (r"(?iuU)\b(grand\s+total|total\s+amount|amount\s+due|balance\s+due|net\s+payable|total\s+payable|"
               r"invoice\s+total)\b")
BANK_DETAILS = (r"(?iuU)\b(bank\s+name|account\s+no|account\s+number|ifsc|swift|upi|neft|rtgs|micr|bank\s+details|"
                r"payment\s+details)\b")
TAX_ID = r"(?U)\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z\d]\b"
SIGNATURE = r"(?iuU)\b(authorized\s+signatory|signature|sign\s+here|stamp|seal|date\s*:\s*|for\s+and\s+on\s+behalf)\b"
COVER_MARKS = ("cover sheet", "summary", "email", "from:", "to:", "subject:", "re:", "forwarded", "printed from",
               "page 1 of", "confidential")
# Confidence per page kind.
CONFIDENCE = {"blank": 0.9, "cover": 0.85, "numbered": 0.95, "header": 0.7, "signed_total": 0.8, "total": 0.6,
              "bank": 0.5, "other": 0.4}
REVIEW_BELOW = 0.5

PAGE_BUCKET = 4096


def with_page_signals(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds has_invoice_word, invoice_number, has_total, has_bank, tax_id, page_type and page_confidence."""
    t = F.col(text)
    found = pages.withColumns({
        "has_invoice_word": t.rlike(INVOICE_WORD), "invoice_number": F.nullif(F.regexp_extract(t, INVOICE_NUMBER, 1), F.lit("")),
        "has_total": t.rlike(TOTAL_BLOCK), "has_bank": t.rlike(BANK_DETAILS),
        "tax_id": F.nullif(F.regexp_extract(t, TAX_ID, 0), F.lit("")), "__signed": t.rlike(SIGNATURE),
        "__cover": F.exists(F.array(*map(F.lit, COVER_MARKS)), lambda m: F.contains(F.lower(t), m)),
        "__blank": F.coalesce(t, F.lit("")).rlike(r"\A[\s]*\z")})
    kinds = (("blank", F.col("__blank"), "unrelated"), ("cover", F.col("__cover"), "cover"),
             ("numbered", F.col("has_invoice_word") & F.col("invoice_number").isNotNull(), "header"),
             ("header", F.col("has_invoice_word"), "header"), ("signed_total", F.col("has_total") & F.col("__signed"), "body"),
             ("total", F.col("has_total"), "body"), ("bank", F.col("has_bank"), "body"))
    page_type, confidence = F.when(F.lit(False), "x"), F.when(F.lit(False), 0.0)
    for name, test, kind in kinds:
        page_type, confidence = page_type.when(test, kind), confidence.when(test, CONFIDENCE[name])
    return found.withColumns({"page_type": page_type.otherwise("continuation"),
                              "page_confidence": confidence.otherwise(CONFIDENCE["other"])}).drop(
        "__signed", "__cover", "__blank")


def group_pages(signals: DataFrame) -> DataFrame:
    """Adds ``invoice_index`` (from 0 per batch) and ``is_owner``, the page that stands for its group.

    A header or cover page opens a group, and so does a tax id other than the one on the page before. The
    page before and the running count are taken bucket-wise, so a very large batch is no single task.
    """
    bucket, order = F.expr(f"page_index div {PAGE_BUCKET}"), [F.col("page_index")]
    prev = previous_value(signals, ["batch_id"], bucket, order, F.struct("page_index", "tax_id"), "__prev")
    first = F.col("__prev").isNull()
    opens = F.col("page_type").isin("header", "cover") | F.coalesce(F.col("tax_id") != F.col("__prev.tax_id"), F.lit(False))
    marked = prev.withColumn("is_owner", first | opens).withColumn("__n", F.when(first, 0).when(opens, 1).otherwise(0))
    return running_sum(marked, ["batch_id"], bucket, order, F.col("__n"), "invoice_index").drop("__prev", "__n")


def invoice_groups(grouped: DataFrame) -> DataFrame:
    """One row per group: pages, first page, invoice number, mean confidence, needs_review.

    A batch of one page is one group with full confidence and no review.
    """
    groups = grouped.groupBy("batch_id", "invoice_index").agg(
        F.count(F.lit(1)).alias("pages"), F.min("page_index").alias("first_page"),
        F.min(F.when(F.col("invoice_number").isNotNull(), F.struct("page_index", "invoice_number"))).alias("__n"),
        F.round(F.avg("page_confidence"), 4).alias("confidence"))
    sizes = groups.groupBy("batch_id").agg(F.sum("pages").alias("__pages"))
    alone = F.col("__pages") == 1
    number = F.when(~alone, F.col("__n.invoice_number"))
    return groups.join(sizes, "batch_id").select(
        "batch_id", "invoice_index", "pages", "first_page", number.alias("invoice_number"),
        F.when(alone, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        (~alone & ((F.col("confidence") < REVIEW_BELOW) | F.col("__n").isNull())).alias("needs_review"))


def page_text_from_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """Text and mean confidence per page from recognised words (position, word, confidence).

    Words without confidence are dropped; a page without any has empty text and confidence 0. The text is
    one value of its page and is put together where that page is.
    """
    kept = F.col("confidence") > 0
    word = F.when(kept, F.struct("position", "word"))
    return words.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda w: w["word"]), " ").alias("text"),
        F.coalesce(F.avg(F.when(kept, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"))


def page_text_from_lists(pages: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """As :func:`page_text_from_words`, for rows that hold an array of (position, word, confidence).

    A page that came as one row is put together in that row, so that only keys cross the shuffle; the words of pages in several
    rows meet. A null or empty array has no words, hence no page.
    """
    repeated = written(pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(
        *[F.col(k).alias(f"__{k}") for k in keys]))  # its size decides how it is joined
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    # Filters aren't pushed below a generator, so the words of a row are made once.
    alone = pages.join(repeated, same, "left_anti").select(*keys, F.explode(F.array(words)).alias("__words")).filter(F.size("__words") > 0)
    kept = F.sort_array(F.transform(F.filter("__words", lambda w: w["confidence"] > 0), lambda w: F.struct(
        w["position"].alias("position"), w["word"].alias("word"), w["confidence"].alias("confidence"))))
    total = F.aggregate("__kept", F.lit(0.0), lambda acc, w: acc + w["confidence"])
    alone = alone.select(*keys, F.explode(F.array(kept)).alias("__kept")).select(
        *keys, F.array_join(F.transform("__kept", lambda w: w["word"]), " ").alias("text"),
        F.when(F.size("__kept") > 0, total / F.size("__kept")).otherwise(0.0).alias("mean_confidence"))
    several = pages.join(repeated, same, "left_semi").select(*keys, F.inline(words))
    return alone.unionByName(page_text_from_words(several, keys))


def page_number(path: Column) -> Column:
    """Page index in a file name ``page_<n>.jpg``."""
    return F.regexp_extract(path, r"page_(\d+)\.[A-Za-z]+\z", 1).try_cast("bigint")
