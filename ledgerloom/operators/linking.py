"""Entity links: supplier names against settlement narrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import (EDIT_MAX_DISTANCE, EDIT_MIN_LENGTH, MATCH_THRESHOLD, PREFIX_MIN_LENGTH, narration_tokens,
                                        nysiis_code, soundex_code, source_tokens, token_set_match, token_synonym)
from ledgerloom.scale import written

# Verdicts.
RESOLVED, MISMATCH = "ENTITY_RESOLVED", "ENTITY_MISMATCH"


def distinct_scores(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``score`` and ``phonetic`` of each distinct pair of token arrays."""
    distinct = pairs.select(left, right).distinct().withColumn("__m", token_set_match(left, right))
    return distinct.select(left, right, F.col("__m.score").alias("score"), F.col("__m.phonetic").alias("phonetic"))


def score_distinct_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``score`` and ``phonetic`` for rows with two token arrays; each distinct pair is scored once.

    Names repeat far more often than rows, and the score is by far the dearest expression.
    """
    return pairs.join(distinct_scores(pairs, left, right), [left, right])


def fuzzy_verdict(pairs: DataFrame, left: str, right: str, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Score, status and the normalized texts the score was computed on."""
    return score_distinct_pairs(pairs, left, right).withColumns({
        "status": F.when(F.col("score") >= threshold, RESOLVED).otherwise(MISMATCH),
        "normalized_source": F.array_join(left, " "), "normalized_target": F.array_join(right, " ")})


# Up to so many letters a word is found by what is left when letters are left out, longer ones by their thirds.
_SHORT = 16
_EDITS = EDIT_MAX_DISTANCE


def _sound_keys(word: str) -> list[Column]:
    """Keys that words share when they are equal, sound alike or one begins with the other; some are NULL."""
    soundex, nysiis = soundex_code(word), nysiis_code(word)
    return [F.concat(F.lit("x"), word), F.when(~soundex.isin("", "0000"), F.concat(F.lit("s"), soundex)),
            F.when(~nysiis.isin("", "aaaaaa"), F.concat(F.lit("n"), nysiis)),
            F.when(F.length(word) >= PREFIX_MIN_LENGTH, F.concat(F.lit("p"), F.left(F.col(word), F.lit(PREFIX_MIN_LENGTH))))]


def _edit_keys(word: str, indexed: bool) -> Column:
    """Keys of which two words within the edit distance share one, the first being asked for and the second ``indexed``.

    Short words share what is left without as many letters. Of a long word's thirds one stays as it is, moved by no more
    places than there are edits, so the indexed word offers its pieces at all these places for all lengths the other can have.
    """
    cut = "transform(sequence(1, length(w)), i -> concat(left(w, i - 1), substring(w, i + 1)))"
    less = f"array({word})"
    for _ in range(_EDITS):
        less = f"flatten(transform({less}, w -> concat(array(w), {cut})))"
    less = f"transform(array_distinct({less}), w -> concat('d', w))"
    third = "concat('e', n, '.', j, substring({word}, {at}, n div 3))"
    if indexed:
        lengths, moves = f"sequence(length({word}) - {_EDITS}, length({word}) + {_EDITS})", f"sequence(-{_EDITS}, {_EDITS})"
        pieces = third.format(word=word, at="greatest(1 + j * (n div 3) + m, 1)")
        pieces = (f"flatten(transform({lengths}, n -> flatten(transform(sequence(0, 2), j -> transform({moves}, m -> {pieces})))))")
        short, long = f"length({word}) <= {_SHORT + _EDITS}", f"length({word}) > {_SHORT - _EDITS}"
    else:
        pieces = third.format(word=word, at="1 + j * (n div 3)")
        pieces = f"flatten(transform(array(length({word})), n -> transform(sequence(0, 2), j -> {pieces})))"
        short, long = f"length({word}) <= {_SHORT}", f"length({word}) > {_SHORT}"
    none = "cast(array() as array<string>)"
    return F.expr(f"CASE WHEN length({word}) < {EDIT_MIN_LENGTH} THEN {none} ELSE concat("
                  f"CASE WHEN {short} THEN {less} ELSE {none} END, CASE WHEN {long} THEN {pieces} ELSE {none} END) END")


def synonyms(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs (a, b) of equal or alike words of ``left`` (a) and ``right`` (b), by an index of keys over distinct words."""
    def keyed(words: DataFrame, word: str, indexed: bool) -> DataFrame:
        keys = F.concat(F.array_compact(F.array(*_sound_keys(word))), _edit_keys(word, indexed))
        return words.select(word, F.explode(F.array_distinct(keys)).alias("key"))

    met = keyed(left, "a", False).join(keyed(right, "b", True), "key").select("a", "b").distinct()
    return met.filter(token_synonym("a", "b").isNotNull())


def _near(threshold: float) -> float:
    return threshold - 0.0001  # scores are rounded to four places


def _words(words: str) -> Column:
    """How many different words there are."""
    return F.size(F.array_distinct(words))


def _fitting_sizes(names: DataFrame, narrated: DataFrame, threshold: float) -> list[tuple[int, int]]:
    """(words of a name, words of a narration) that occur and can score ``threshold``: as many pairs as there are lengths."""
    a_sizes, b_sizes = ([r[0] for r in df.select(_words(c)).distinct().collect()] for df, c in ((names, "__a"), (narrated, "__b")))
    return [(a, b) for a in a_sizes for b in b_sizes if a is not None and b is not None and min(a, b) >= _near(threshold) * max(a, b)]


def _possible_pairs(names: DataFrame, targets: DataFrame, threshold: float, fitting: list[tuple[int, int]]) -> DataFrame:
    """(vendor_code, __a, __b) that can score ``threshold``, by the rarest word of one side; sizes as :func:`_fitting_sizes` has them.

    With a score above 0 all words of the smaller side are found on the other: as they are, or as synonyms if the sides have
    equally many. So the rarest word of the smaller side leads to all its partners, and no vendor's names meet all its narrations.
    """
    near = _near(threshold)
    sized = lambda df, words: df.select("vendor_code", words).distinct().withColumn(f"{words}n", _words(words))
    left, right = sized(names, "__a"), sized(targets, "__b")
    a_words = written(left.filter(F.col("__an").isin([a for a, _ in fitting])).select("*", F.explode(F.array_distinct("__a")).alias("a")))
    b_words = written(right.filter(F.col("__bn").isin([b for _, b in fitting])).select("*", F.explode(F.array_distinct("__b")).alias("b")))
    alike = written(synonyms(a_words.select("a").distinct(), b_words.select("b").distinct()))
    in_b = b_words.groupBy("vendor_code", "b").agg(F.count(F.lit(1)).alias("rows"))
    in_a = a_words.groupBy("vendor_code", "a").agg(F.count(F.lit(1)).alias("rows"))
    reach = (a_words.select("vendor_code", "a").distinct().join(alike, "a").join(in_b, ["vendor_code", "b"])
             .groupBy("vendor_code", "a").agg(F.sum("rows").alias("rows")))

    def rarest(words: DataFrame, word: str, side: str, counts: DataFrame) -> DataFrame:
        return (words.join(counts, ["vendor_code", word], "left").groupBy("vendor_code", side, f"{side}n")
                .agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), word)).alias("r"))
                .filter("r.rows > 0").select("vendor_code", side, f"{side}n", F.col(f"r.{word}").alias(word)))

    pair = ("vendor_code", "__a", "__b")
    from_a = (rarest(a_words, "a", "__a", reach).join(alike, "a").join(b_words, ["vendor_code", "b"])
              .filter(f"__an <= __bn AND __an >= {near} * __bn").select(*pair))
    # Only narrations of fewer words than some name are the smaller side.
    shorter = [b for a, b in fitting if b < a]
    from_b = (rarest(b_words.filter(F.col("__bn").isin(shorter)), "b", "__b", in_a.withColumnRenamed("a", "b"))
              .join(a_words.withColumnRenamed("a", "b"), ["vendor_code", "b"])
              .filter(f"__bn < __an AND __bn >= {near} * __an").select(*pair))
    wordless = left.filter("__an = 0").join(right.filter("__bn = 0"), "vendor_code").select(*pair)
    return from_a.union(from_b).union(wordless).distinct()


def best_settlement(invoices: DataFrame, settlements: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Best-scoring settlement per (vendor, supplier name) among all narrated ones of the vendor.

    Distinct names meet those distinct narrations of their vendor that can reach ``threshold`` (above 0), each as its newest
    settlement; the newest wins a tie.
    Rows: vendor_code, supplier_legal_name, fuzzy_payout_id, fuzzy_utr, fuzzy_amount_paise, fuzzy_score.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 would link every name to every narration")
    names = written(invoices.select("vendor_code", "supplier_legal_name").distinct().withColumn(
        "__a", source_tokens("supplier_legal_name")))
    narrated = settlements.filter("utr IS NOT NULL AND narration <> ''").withColumn("__b", narration_tokens("narration"))
    newest = F.max(F.struct("ingested_epoch", "payout_id", "utr", "amount_paise")).alias("s")
    # Narrations of a length that no name can match are left out before anything is shipped.
    fitting = _fitting_sizes(names, narrated, threshold)
    targets = written(narrated.filter(_words("__b").isin([b for _, b in fitting])).groupBy("vendor_code", "__b").agg(newest).select(
        "vendor_code", "__b", "s.*"))
    pairs = score_distinct_pairs(_possible_pairs(names, targets, threshold, fitting), "__a", "__b").filter(F.col("score") >= threshold)
    scored = pairs.join(names, ["vendor_code", "__a"]).join(targets, ["vendor_code", "__b"])
    best = scored.groupBy("vendor_code", "supplier_legal_name").agg(F.max_by(
        F.struct("payout_id", "utr", "amount_paise", "score"),
        F.struct("score", "ingested_epoch", "payout_id")).alias("b"))
    return best.select("vendor_code", "supplier_legal_name", F.col("b.payout_id").alias("fuzzy_payout_id"),
                       F.col("b.utr").alias("fuzzy_utr"), F.col("b.amount_paise").alias("fuzzy_amount_paise"),
                       F.col("b.score").alias("fuzzy_score"))
