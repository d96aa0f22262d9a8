"""Line dedup by site-relative frequency.

For each host, the number of its pages that have a line is divided by the number of its pages; lines above a ratio
(and on ``least`` pages or more) are boilerplate there and are dropped from its pages. A line of ``LONG`` letters or more hardly
comes twice by chance, so a tenth of the ratio is enough for it. A line counts once for each page, is
compared without blanks at its ends, and by 128 bits of hash. Counts are summed before the shuffle, so that a line on a third
of all pages, or a host with a third of them, is one row for each task. The boilerplate lines of a host are bounded: there are
at most (lines of an average page / ratio) of them.

Defined results: a null text stays null and has no lines; a null host is a host of its own; blank lines are neither judged nor
dropped; repeated rows are pages each; a line exactly at its ratio stays; texts of any length are read whole; no rows give no
rows; other columns are kept whatever their names, but for ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import if_small, stored

RATIO = 50  # of 10,000 pages of a host
LONG, LONG_RATIO = 120, 5
LEAST = 3


def _key(line: Column) -> Column:
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"), (F.length(line) >= LONG).alias("long"))


def boilerplate(docs: DataFrame, host: str, ratio: int = RATIO, least: int = LEAST, long_ratio: int = LONG_RATIO) -> DataFrame:
    """host, dropped (line keys) for the hosts that have boilerplate lines."""
    rows = docs.select(F.col(host).alias("host"), F.split("text", "\n").alias("lines"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    found = F.transform(F.filter("lines", lambda x: F.trim(x) != ""), _key)
    counts = (rows.select("host", F.explode(F.array_distinct(found)).alias("line"))
              .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))
    needed = F.col("t.pages") * F.when(F.col("c.line.long"), long_ratio).otherwise(ratio)
    over = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")) & (F.col("c.n") * 10_000 > needed))
    return over.groupBy(F.col("c.host").alias("host")).agg(F.collect_list("line").alias("dropped"))


def without_boilerplate(docs: DataFrame, host: str = "source", ratio: int = RATIO, least: int = LEAST,
                        long_ratio: int = LONG_RATIO) -> DataFrame:
    """The rows of ``docs`` with ``text`` less its boilerplate lines, and ``n_lines``, ``n_dropped``."""
    known = stored(boilerplate(docs, host, ratio, least, long_ratio), "boilerplate")
    size = known.agg(F.sum(F.size("dropped"))).first()[0] or 0
    # The caller's columns travel as one, so that no name of theirs meets one of ours.
    rows = docs.select(F.struct("*").alias("own"), F.split("text", "\n").alias("lines"))
    joined = rows.join(if_small(known, size), F.col(f"own.`{host}`").eqNullSafe(F.col("host")), "left")
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.coalesce(F.array_contains("dropped", _key(x)), F.lit(False))))
    whole = F.col("own.text").isNotNull()
    done = joined.select("own", "lines", kept.alias("kept"))
    return done.select(
        *[F.array_join("kept", "\n").alias("text") if c == "text" else F.col(f"own.`{c}`").alias(c)
          for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.when(whole, F.size("lines")).otherwise(0).alias("n_lines"),
        F.when(whole, F.size("lines") - F.size("kept")).otherwise(0).alias("n_dropped"))


# The same in DuckDB, for documents with their source as host.
SQL = f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS pages FROM rows GROUP BY source),
found AS (SELECT DISTINCT r, source, trim(line, ' ') AS line FROM (SELECT r, source, unnest(lines) AS line FROM rows)
          WHERE trim(line, ' ') <> ''),
counts AS (SELECT source, line, count(*) AS n FROM found GROUP BY ALL HAVING count(*) >= {LEAST}),
boiler AS (SELECT c.source, list(c.line) AS dropped FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
           WHERE c.n * 10000 > t.pages * CASE WHEN length(c.line) >= {LONG} THEN {LONG_RATIO} ELSE {RATIO} END GROUP BY c.source),
kept AS (SELECT doc_id, text, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(dropped, []), trim(x, ' '))) AS k
         FROM rows LEFT JOIN boiler ON rows.source IS NOT DISTINCT FROM boiler.source)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE CAST(len(lines) AS INTEGER) END AS n_lines,
       CASE WHEN text IS NULL THEN 0 ELSE CAST(len(lines) - len(k) AS INTEGER) END AS n_dropped,
       array_to_string(k, chr(10)) AS text FROM kept
"""
