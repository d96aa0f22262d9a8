"""Entity-name comparison: tokens, noise removal, phonetic codes and the token-set score.

All of it is column expressions; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about who a company is.
CORPORATE_NOISE = (
    "pvt", "private", "limited", "ltd", "llp", "inc", "incorporated", "corp", "corporation", "co",
    "company", "group", "holdings", "and", "the", "of", "llc",
)

# Transfer modes, payment apps, banks and places that fill bank narrations.
BANK_NOISE = (
    "imps", "neft", "rtgs", "upi", "nach", "ach", "transfer", "trf",
    "paytm", "phonepe", "googlepay", "gpay", "bhim",
    "hdfc", "icici", "sbi", "axis", "kotak", "yesbank", "idfc",
    "indusind", "canara", "pnb", "boi", "union", "citi", "hsbc", "rbl",
    "mumbai", "delhi", "bangalore", "bengaluru", "chennai", "kolkata",
    "pune", "hyderabad", "ahmedabad", "jaipur", "gurgaon", "noida",
    "india", "inr",
)

# Letters that carry a soundex digit, and the digit of each.
SOUNDEX_LETTERS = "bfpvcgjkqsxzdtlmnr"
SOUNDEX_DIGITS = "111122222222334556"

# Letter groups of the simplified NYSIIS code, applied in this order.
NYSIIS_GROUPS = (
    ("ph", "f"), ("kn", "n"), ("sch", "s"), ("ee", "y"), ("ie", "y"),
    ("dt", "d"), ("rt", "d"), ("rd", "d"), ("nt", "d"), ("nd", "d"),
)

# Single letters after the first one; ``h`` has no counterpart and drops out.
NYSIIS_FROM = "aeiouqzmkh"
NYSIIS_TO = "aaaaagsnc"

MATCH_THRESHOLD = 0.85
PREFIX_MIN_LENGTH = 4
EDIT_MIN_LENGTH = 5
EDIT_MAX_DISTANCE = 2


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(_c(text)), "[^a-z0-9]+"), lambda t: t != "")


def strip_noise(tokens: Column, narration: bool, corporate: Sequence[str] = CORPORATE_NOISE,
                bank: Sequence[str] = BANK_NOISE) -> Column:
    """Drop company words; for a narration also bank words and bare numbers. Repeats and order stay."""
    if narration:
        words = list(corporate) + list(bank)
        return F.filter(tokens, lambda t: ~t.isin(*words) & ~t.rlike(r"\A[0-9]+\z"))
    return F.filter(tokens, lambda t: ~t.isin(*corporate))


def source_tokens(name: Column | str, corporate: Sequence[str] = CORPORATE_NOISE) -> Column:
    return strip_noise(tokenize(name), narration=False, corporate=corporate)


def narration_tokens(text: Column | str, corporate: Sequence[str] = CORPORATE_NOISE,
                     bank: Sequence[str] = BANK_NOISE) -> Column:
    return strip_noise(tokenize(text), narration=True, corporate=corporate, bank=bank)


def soundex_code(word: Column | str) -> Column:
    """Soundex in which a letter without a digit never separates two equal digits.

    Keep the coded letters, turn them into digits, fold repeats, and leave out the digit that belongs to
    the first letter itself. ``tymczak`` is T520 here and T522 with the built-in function.
    """
    w = F.lower(_c(word))
    digits = F.regexp_replace(
        F.translate(F.regexp_replace(w, f"[^{SOUNDEX_LETTERS}]", ""), SOUNDEX_LETTERS, SOUNDEX_DIGITS),
        r"(.)\1+", "$1")
    first = F.substring(w, 1, 1)
    rest = F.when(first.rlike(f"[{SOUNDEX_LETTERS}]"), F.substring(digits, 2, 3)).otherwise(digits)
    return F.when(w == "", F.lit("")).otherwise(F.rpad(F.concat(F.upper(first), rest), 4, "0"))


def nysiis_code(word: Column | str) -> Column:
    """Simplified six-letter NYSIIS; NULL for the few words that lose all their letters."""
    w = F.lower(_c(word))
    s = F.regexp_replace(F.regexp_replace(w, r"\Amac", "mc"), r"\Apf", "")
    s = F.regexp_replace(F.regexp_replace(s, r"ey\z", "y"), r"e\z", "")
    for old, new in NYSIIS_GROUPS:
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.concat(F.substring(s, 1, 1), F.translate(F.substring(s, 2, 1 << 30), NYSIIS_FROM, NYSIIS_TO))
    s = F.regexp_replace(F.regexp_replace(s, r"(.)\1+", "$1"), r"(?<=.)s\z", "")
    return F.when(~w.rlike(r"\A(pf)?e?\z"), F.rpad(s, 6, "a"))


def edit_within(a: Column, b: Column, limit: int = EDIT_MAX_DISTANCE) -> Column:
    """Levenshtein distance at most ``limit``; the bounded built-in stops early and says -1 beyond it."""
    return F.levenshtein(a, b, limit) >= 0


def _coded(token: Column) -> Column:
    return F.struct(token.alias("t"), soundex_code(token).alias("s"), nysiis_code(token).alias("n"))


def _phonetic(x: Column, y: Column) -> Column:
    same_soundex = (x["s"] == y["s"]) & ~x["s"].isin("", "0000")
    same_nysiis = F.coalesce((x["n"] == y["n"]) & ~x["n"].isin("", "aaaaaa"), F.lit(False))
    return same_soundex | same_nysiis


def _prefix(x: Column, y: Column) -> Column:
    both_long = (F.length(x["t"]) >= PREFIX_MIN_LENGTH) & (F.length(y["t"]) >= PREFIX_MIN_LENGTH)
    return both_long & (x["t"].startswith(y["t"]) | y["t"].startswith(x["t"]))


def _edit(x: Column, y: Column) -> Column:
    both_long = (F.length(x["t"]) >= EDIT_MIN_LENGTH) & (F.length(y["t"]) >= EDIT_MIN_LENGTH)
    return both_long & edit_within(x["t"], y["t"])


def token_synonym(a: Column | str, b: Column | str) -> Column:
    """Method by which two tokens count as the same word, NULL if by none; the first that applies wins."""
    x, y = _coded(_c(a)), _coded(_c(b))
    same_soundex = (x["s"] == y["s"]) & ~x["s"].isin("", "0000")
    return (F.when(_c(a) == _c(b), F.lit("exact")).when(same_soundex, F.lit("soundex"))
            .when(_phonetic(x, y), F.lit("nysiis")).when(_prefix(x, y), F.lit("prefix"))
            .when(_edit(x, y), F.lit("edit")))


def soundex_sql(w: str) -> str:
    """:func:`soundex_code` as SQL text, for use inside lambdas."""
    return (f"rpad(concat(upper(substring({w}, 1, 1)), substring(regexp_replace(translate(regexp_replace(lower({w}), "
            f"'[^{SOUNDEX_LETTERS}]', ''), '{SOUNDEX_LETTERS}', '{SOUNDEX_DIGITS}'), r'(.)\\1+', '$1'), "
            f"CASE WHEN lower(substring({w}, 1, 1)) RLIKE '[{SOUNDEX_LETTERS}]' THEN 2 ELSE 1 END)), 4, '0')")


def nysiis_sql(w: str) -> str:
    """:func:`nysiis_code` as SQL text."""
    s = rf"regexp_replace(regexp_replace(lower({w}), r'\Amac', 'mc'), r'\Apf', '')"
    s = rf"regexp_replace(regexp_replace({s}, r'ey\z', 'y'), r'e\z', '')"
    for old, new in NYSIIS_GROUPS:
        s = f"replace({s}, '{old}', '{new}')"
    s = f"concat(substring({s}, 1, 1), translate(substring({s}, 2), '{NYSIIS_FROM}', '{NYSIIS_TO}'))"
    s = rf"regexp_replace(regexp_replace({s}, r'(.)\1+', '$1'), r'(?<=.)s\z', '')"
    return rf"CASE WHEN NOT lower({w}) RLIKE r'\A(pf)?e?\z' THEN rpad({s}, 6, 'a') END"


def _sound_sql(x: str, y: str) -> str:
    return (f"(({x}.s = {y}.s AND {x}.s NOT IN ('', '0000')) OR "
            f"coalesce({x}.n = {y}.n AND {x}.n NOT IN ('', 'aaaaaa'), false))")


def _prefix_sql(x: str, y: str) -> str:
    return (f"(length({x}.t) >= {PREFIX_MIN_LENGTH} AND length({y}.t) >= {PREFIX_MIN_LENGTH} AND "
            f"(startswith({x}.t, {y}.t) OR startswith({y}.t, {x}.t)))")


def _edit_sql(x: str, y: str) -> str:
    return (f"(length({x}.t) >= {EDIT_MIN_LENGTH} AND length({y}.t) >= {EDIT_MIN_LENGTH} AND "
            f"levenshtein({x}.t, {y}.t, {EDIT_MAX_DISTANCE}) >= 0)")


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is then evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def token_set_sql(left: str, right: str) -> str:
    """SQL text of the token-set score of two token arrays, ``struct<score, phonetic>``.

    One side containing the other scores smaller / larger. Otherwise every word found on one side only
    must pair with a free synonym on the other (left words in order, first free synonym wins); any word
    left over makes the score 0. With nothing left over the sides have equal size and the score is 1.
    """
    def coded(words: str) -> str:
        return f"transform({words}, t -> named_struct('t', t, 's', {soundex_sql('t')}, 'n', {nysiis_sql('t')}))"

    def verdict(score: str, phonetic: str) -> str:
        return f"named_struct('score', {score}, 'phonetic', {phonetic})"

    synonym = f"({_sound_sql('x', 'y')} OR {_prefix_sql('x', 'y')} OR {_edit_sql('x', 'y')})"
    heard = f"coalesce({_sound_sql('x', 'h')} OR (NOT {_prefix_sql('x', 'h')} AND {_edit_sql('x', 'h')}), false)"
    step = _let("h", f"get(filter(acc.free, y -> {synonym}), 0)",
                "named_struct('free', CASE WHEN h IS NULL THEN acc.free ELSE filter(acc.free, y -> y.t <> h.t) END, "
                f"'paired', acc.paired + CASE WHEN h IS NULL THEN 0 ELSE 1 END, 'phonetic', acc.phonetic OR {heard})")
    pairing = (f"aggregate(u.oa, named_struct('free', u.ob, 'paired', 0, 'phonetic', false), (acc, x) -> {step}, acc -> "
               + verdict("CASE WHEN size(acc.free) = 0 AND acc.paired = size(u.oa) THEN 1.0D ELSE 0.0D END",
                         "acc.phonetic") + ")")
    choice = (f"CASE WHEN u.na = 0 AND u.nb = 0 THEN {verdict('1.0D', 'false')} "
              f"WHEN u.na = 0 OR u.nb = 0 THEN {verdict('0.0D', 'false')} "
              "WHEN size(u.oa) = 0 OR size(u.ob) = 0 THEN "
              + verdict("cast(round(least(u.na, u.nb) / greatest(u.na, u.nb), 4) AS double)", "false")
              + f" ELSE {pairing} END")
    sides = ("named_struct('na', size(v.a), 'nb', size(v.b), "
             f"'oa', {coded('array_except(v.a, v.b)')}, 'ob', {coded('array_except(v.b, v.a)')})")
    return _let("v", f"named_struct('a', array_distinct({left}), 'b', array_distinct({right}))",
                _let("u", sides, choice))


def token_set_match(left: str, right: str) -> Column:
    """``struct(score, phonetic)`` of two token-array columns, given by name."""
    return F.expr(token_set_sql(left, right))
