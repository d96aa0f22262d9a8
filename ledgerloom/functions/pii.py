"""Personal and bank identifiers: finding, masking, and reversible tokens per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.scale import cut_lineage, ordinal

# Pattern, placeholder and token label per entity, highest score first. Case is ignored.
ENTITIES = {
    "IN_GSTIN": (r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]", "[GSTIN_REDACTED]", "GSTIN"),
    "IN_AADHAAR": (r"[0-9]{4}[ ]?[0-9]{4}[ ]?[0-9]{4}", "[AADHAAR_REDACTED]", "AADHAAR"),
    "IN_PAN": (r"[A-Z]{5}[0-9]{4}[A-Z]", "[PAN_REDACTED]", "PAN"),
    "IN_IFSC": (r"[A-Z]{4}0[A-Z0-9]{6}", "[IFSC_REDACTED]", "IFSC"),
    "BANK_ACCOUNT": (r"[0-9]{9,18}", "[ACCOUNT_REDACTED]", "ACCOUNT"),
}
# A digit run is an account only with one of these words up to 80 characters before or 30 after.
ACCOUNT_WORDS = ("account", "acc", "bank", "savings", "beneficiary", "ifsc")
LOOK_BACK, LOOK_AHEAD = 80, 30
TOKEN_PATTERN = r"\[[A-Z]+_TOKEN_[0-9]+\]"
STRUCTURED_FIELDS = {"pan": "IN_PAN", "gstin": "IN_GSTIN", "account_number": "BANK_ACCOUNT", "ifsc": "IN_IFSC"}

COMBINED = r"(?iU)\b(?:" + "|".join(p for p, _, _ in ENTITIES.values()) + r")\b"


# A hit has nine letters at least, so that so many hits with their gaps cover what is looked at on either side.
_SHORTEST = 9


def with_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``gaps`` (text pieces between candidate hits) and ``spans`` (the hits, in order).

    A span is ``struct(value, entity)``; entity is NULL for a digit run without an account word
    around it, which stays as it is. One pattern with the entities in score order finds all hits in one
    pass over the whole text, so at equal starts the higher score wins. What is around a hit is put together from
    the few hits and gaps beside it, so that the time follows the length of the text and the number of hits.
    """
    back, ahead = LOOK_BACK // _SHORTEST + 1, LOOK_AHEAD // _SHORTEST + 1
    before = (f"right(concat(array_join(transform(slice(__near, greatest(i - {back}, 0) + 1, least(i, {back})), q -> concat(q.tail, q.value)), ''),"
              f" s.tail), {LOOK_BACK})")
    after = (f"left(concat(s.head, array_join(transform(slice(__near, i + 2, {ahead}), q -> concat(q.value, q.head)), '')), {LOOK_AHEAD})")
    kinds = "CASE " + " ".join(
        f"WHEN s.value RLIKE r'(?i)\\A{p}\\z' THEN '{name}'" for name, (p, _, _) in ENTITIES.items() if name != "BANK_ACCOUNT"
    ) + f" WHEN lower(concat({before}, s.value, {after})) RLIKE '{'|'.join(ACCOUNT_WORDS)}' THEN 'BANK_ACCOUNT' END"
    near = (f"transform(__hits, (m, i) -> named_struct('value', m, 'tail', right(gaps[i], {LOOK_BACK}), 'head', left(gaps[i + 1], {LOOK_AHEAD})))")
    return (df.withColumn("__hits", F.regexp_extract_all(F.col(text), F.lit(COMBINED), 0))
            .withColumn("gaps", F.split(F.col(text), COMBINED))
            .withColumn("__near", F.explode(F.array(F.expr(near))))  # filters aren't pushed below a generator, so hits are found once
            .withColumn("spans", F.expr(f"transform(__near, (s, i) -> named_struct('value', s.value, 'entity', {kinds}))"))
            .drop("__hits", "__near"))


def _rebuilt(replacement: str) -> Column:
    """Text from gaps and spans, each span ``s`` (the ``i``-th) replaced by the SQL ``replacement``."""
    return F.expr(f"concat(array_join(transform(spans, (s, i) -> concat(gaps[i], {replacement})), ''), element_at(gaps, -1))")


def masked_text() -> Column:
    """Text with every found identifier replaced by its placeholder; needs ``gaps`` and ``spans``."""
    case = " ".join(f"WHEN '{n}' THEN '{ph}'" for n, (_, ph, _) in ENTITIES.items())
    return _rebuilt(f"CASE s.entity {case} ELSE s.value END")


def vault_entries() -> Column:
    """``array<struct(name, value)>``: what was masked, numbered per entity in text order."""
    each = F.transform("spans", lambda s, i: F.struct(i.alias("i"), s["entity"].alias("entity"), s["value"].alias("value")))

    def numbered(entity: str) -> Column:
        return F.transform(F.filter(each, lambda s: s["entity"] == entity), lambda s, j: F.struct(
            s["i"].alias("i"), F.concat_ws("_", s["entity"], (j + 1).cast("string")).alias("name"), s["value"].alias("value")))

    by_entity = [numbered(entity) for entity in ENTITIES]
    return F.transform(F.array_sort(F.concat(*by_entity)), lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value")))


def mask_document(body: Column) -> Column:
    """Document struct with bank, tax and company identifiers replaced by placeholders."""
    bank, sup, buy = body["banking_details"], body["supplier_details"], body["buyer_details"]
    number = bank["account_number"]

    def hide(party: Column) -> Column:
        for field, entity in (("pan", "IN_PAN"), ("gstin", "IN_GSTIN")):
            old = party[field]
            party = party.withField(field, F.when(F.coalesce(old, F.lit("")) != "", ENTITIES[entity][1]).otherwise(old))
        return party

    given = F.coalesce(number, F.lit("")) != ""
    tail = F.when(F.length(number) >= 4, F.concat(F.lit("XXXX-"), F.right(number, F.lit(4)))).otherwise("XXXX")
    bank = (bank.withField("account_number_masked", F.when(given, tail).otherwise(bank["account_number_masked"]))
            .withField("account_number", F.when(given, ENTITIES["BANK_ACCOUNT"][1]).otherwise(number))
            .withField("ifsc", F.when(F.coalesce(body["banking_details"]["ifsc"], F.lit("")) != "", ENTITIES["IN_IFSC"][1])
                       .otherwise(body["banking_details"]["ifsc"])))
    return body.withField("banking_details", bank).withField("supplier_details", hide(sup)).withField(
        "buyer_details", hide(buy))


def document_findings(docs: DataFrame) -> DataFrame:
    """Identifiers of a document's structured fields: supplier, buyer, then bank, as (.., position, entity, value)."""
    body = F.col("doc.body")
    parts = [(s, f) for s in ("supplier_details", "buyer_details") for f in ("pan", "gstin")]
    parts += [("banking_details", f) for f in ("account_number", "ifsc")]
    found = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(STRUCTURED_FIELDS[f]).alias("entity"),
                               body[s][f].alias("value")) for i, (s, f) in enumerate(parts)])
    kept = F.filter(found, lambda x: F.trim(F.coalesce(x["value"], F.lit(""))) != "")
    return docs.select("run_id", "doc_order", F.explode(kept).alias("f")).select("run_id", "doc_order", "f.*")


def text_findings(spans: DataFrame) -> DataFrame:
    """Found identifiers of texts with ``spans``, with their place ``i`` among the spans, which is their ``position`` too."""
    return spans.select("run_id", "doc_order", F.posexplode("spans").alias("i", "f")).filter("f.entity IS NOT NULL").select(
        "run_id", "doc_order", "i", F.col("i").alias("position"), F.col("f.entity").alias("entity"), F.col("f.value").alias("value"))


def run_vault(findings: DataFrame, bucket: Column) -> DataFrame:
    """(run_id, entity, value, token): one token per distinct value of a run, numbered by first appearance.

    ``bucket`` is a function of doc_order that does not decrease. The vault holds the plain values: keep it
    out of anything that is stored.
    """
    labels = F.create_map(*[x for n, (_, _, lab) in ENTITIES.items() for x in (F.lit(n), F.lit(lab))])
    first = findings.groupBy("run_id", "entity", "value").agg(F.min(F.struct("doc_order", "position")).alias("first"))
    named = first.withColumn("label", F.coalesce(F.try_element_at(labels, F.col("entity")), F.lit("PII"))).withColumn(
        "doc_order", F.col("first.doc_order"))
    numbered = ordinal(named, ["run_id", "label"], bucket, [F.col("first"), F.col("entity"), F.col("value")], "n")
    return numbered.select("run_id", "entity", "value", F.concat(
        F.lit("["), "label", F.lit("_TOKEN_"), F.col("n").cast("string"), F.lit("]")).alias("token"))


def tokenize_text(texts: DataFrame, findings: DataFrame, vault: DataFrame) -> DataFrame:
    """Texts with every found identifier replaced by its run token: (run_id, doc_order, text).

    The tokens join the bare texts; the pieces are cut afterwards and do not cross the shuffle.
    """
    tokens = findings.join(vault, ["run_id", "entity", "value"]).groupBy("run_id", "doc_order").agg(
        F.map_from_entries(F.collect_list(F.struct("i", "token"))).alias("tokens"))
    return with_spans(texts.join(tokens, ["run_id", "doc_order"], "left")).select(
        "run_id", "doc_order", _rebuilt("coalesce(try_element_at(tokens, i), s.value)").alias("text"))


def tokenize_run(texts: DataFrame, bucket: Column) -> tuple[DataFrame, DataFrame]:
    """(tokenized texts, vault) for texts (run_id, doc_order, text).

    The findings are few and narrow next to the texts; they are written out once, so that the texts are
    searched once for them and once for the replacement.
    """
    findings = cut_lineage(text_findings(with_spans(texts)))
    vault = run_vault(findings, bucket)
    return tokenize_text(texts, findings, vault), vault


def rehydrate_text(texts: DataFrame, vault: DataFrame) -> DataFrame:
    """Texts with known tokens turned back into their values; unknown tokens stay."""
    parts = texts.withColumns({"spans": F.transform(F.regexp_extract_all(F.col("text"), F.lit(TOKEN_PATTERN), 0),
                                                    lambda t: F.struct(t.alias("value"))),
                               "gaps": F.split(F.col("text"), TOKEN_PATTERN)})
    used = parts.select("run_id", "doc_order", F.explode("spans.value").alias("token")).distinct().join(
        vault.select("run_id", "token", "value"), ["run_id", "token"]).groupBy("run_id", "doc_order").agg(
        F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("plain"))
    return parts.join(used, ["run_id", "doc_order"], "left").select(
        "run_id", "doc_order", _rebuilt("coalesce(try_element_at(plain, s.value), s.value)").alias("text"))
