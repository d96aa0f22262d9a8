"""DuckDB SQL for the token-set score, used by the checks of every query that compares names."""

from __future__ import annotations

from ledgerloom.functions.text import BANK_NOISE, CORPORATE_NOISE, NYSIIS_GROUPS


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda t: t <> '')"


def source_sql(name: str) -> str:
    return f"list_filter({tokens_sql(name)}, lambda t: NOT list_contains({_list(CORPORATE_NOISE)}, t))"


def narration_sql(text: str) -> str:
    return (f"list_filter({tokens_sql(text)}, lambda t: NOT list_contains({_list(CORPORATE_NOISE + BANK_NOISE)}, t)"
            " AND NOT regexp_full_match(t, '[0-9]+'))")


def codes_sql(tokens_cte: str, prefix: str = "") -> str:
    """CTEs ending in ``code(t, sdx, nys)`` for the distinct words in ``tokens_cte(t)``."""
    p = prefix
    groups = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^mac', 'mc'), '^pf', ''), 'ey$', 'y'), 'e$', '')"
    for old, new in NYSIIS_GROUPS:
        groups = f"replace({groups}, '{old}', '{new}')"

    def fold(s: str) -> str:
        return (f"array_to_string(list_filter(string_split({s}, ''), "
                f"lambda c, i: i = 1 OR c <> {s}[(i - 1)::int]), '')")

    return f"""
{p}c0 AS (SELECT t, translate(regexp_replace(t, '[^bfpvcgjkqsxzdtlmnr]', '', 'g'), 'bfpvcgjkqsxzdtlmnr',
    '111122222222334556') AS d, {groups} AS g FROM {tokens_cte}),
{p}c1 AS (SELECT t, {fold('d')} AS d, g[1] || translate(g[2:], 'aeiouqzmkh', 'aaaaagsnc') AS g FROM {p}c0),
{p}c2 AS (SELECT t, d, {fold('g')} AS g FROM {p}c1),
{p}code AS (SELECT t,
    rpad(upper(t[1]) || CASE WHEN regexp_matches(t[1], '[bfpvcgjkqsxzdtlmnr]') THEN d[2:4] ELSE d END, 4, '0') AS sdx,
    CASE WHEN NOT regexp_full_match(t, '(pf)?e?') THEN
      rpad(CASE WHEN length(g) > 1 AND suffix(g, 's') THEN g[:length(g) - 1] ELSE g END, 6, 'a') END AS nys FROM {p}c2)"""


SAME_SOUNDEX = "({x}.s = {y}.s AND {x}.s NOT IN ('', '0000'))"
SAME_NYSIIS = "coalesce({x}.n = {y}.n AND {x}.n NOT IN ('', 'aaaaaa'), false)"
PREFIX = "(length({x}.t) >= 4 AND length({y}.t) >= 4 AND (starts_with({x}.t, {y}.t) OR starts_with({y}.t, {x}.t)))"
EDIT = "(length({x}.t) >= 5 AND length({y}.t) >= 5 AND levenshtein({x}.t, {y}.t) <= 2)"


def score_sql(pairs: str, prefix: str = "") -> str:
    """CTEs ending in ``scored(id, score, phonetic)`` for ``pairs(id, a, b)`` with token lists a and b."""
    p = prefix

    def rule(text: str, x: str, y: str) -> str:
        return text.format(x=x, y=y)

    any_rule = " OR ".join(rule(r, "x", "y") for r in (SAME_SOUNDEX, SAME_NYSIIS, PREFIX, EDIT))
    hit = f"list_filter(acc.free, lambda y: {any_rule})[1]"
    by_sound = "{s} OR {n} OR (NOT {p} AND {e})".format(
        s=rule(SAME_SOUNDEX, "x", hit), n=rule(SAME_NYSIIS, "x", hit), p=rule(PREFIX, "x", hit),
        e=rule(EDIT, "x", hit))
    coded = f"lambda q: {{'t': q, 's': m[q].s, 'n': m[q].n}}"
    return f"""
{p}tok AS (SELECT DISTINCT unnest(list_concat(a, b)) AS t FROM {pairs}),
{codes_sql(p + 'tok', p)},
{p}cm AS (SELECT map_from_entries(list({{'key': t, 'value': {{'s': sdx, 'n': nys}}}})) AS m FROM {p}code),
{p}uniq AS (SELECT id, list_filter(a, lambda q, i: list_position(a, q) = i) AS a,
    list_filter(b, lambda q, i: list_position(b, q) = i) AS b FROM {pairs}),
{p}rest AS (SELECT id, a, b, list_filter(a, lambda q: NOT list_contains(b, q)) AS ra,
    list_filter(b, lambda q: NOT list_contains(a, q)) AS rb FROM {p}uniq),
{p}walk AS (SELECT id, a, b, ra, rb, list_reduce(list_transform(ra, {coded}),
    lambda acc, x: {{'free': list_filter(acc.free, lambda z: {hit} IS NULL OR z.t <> {hit}.t),
      'paired': acc.paired + CASE WHEN {hit} IS NULL THEN 0 ELSE 1 END,
      'ph': acc.ph OR coalesce({by_sound}, false)}},
    {{'free': list_transform(rb, {coded}), 'paired': 0, 'ph': false}}) AS w FROM {p}rest, {p}cm),
{p}scored AS (SELECT id,
    CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
      WHEN len(ra) = 0 OR len(rb) = 0 THEN round(least(len(a), len(b)) / greatest(len(a), len(b)), 4)
      WHEN len(w.free) = 0 AND w.paired = len(ra) THEN 1.0 ELSE 0.0 END::double AS score,
    len(ra) > 0 AND len(rb) > 0 AND w.ph AS phonetic FROM {p}walk)"""
