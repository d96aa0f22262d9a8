"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

Each source's target divided by its size is the wanted number of copies of each of its documents. The whole part is taken of
all; the fraction is a probability, rounded by pivotal steps: of two documents with probabilities a and b one is settled, so
that the sum stays what it was. If a + b < 1, one of them drops out and the other goes on with a + b; else one is taken and
the other goes on with a + b - 1; which one is drawn so that every document keeps its probability. Documents of near size
meet first (geometric size classes), so that the words taken stay near the target, too.

The steps form a reduction tree: a group of about ``FAN_IN`` documents settles all but one, and these residues meet in the next
round, first within the size class, then across classes, at last one for each source. Probabilities are whole numbers of
``ONE``ths, and draws are hashes of the two documents, so that reruns agree and nothing is lost by rounding.

Rows with equal doc_id, source and size are one unit, and all get the same number of copies. Defined results: a null text has
size 0 and its documents take 0 words; a null source is a source of its own, the last; a source without words has target 0; no
rows give no rows. Only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import if_small, stored, word_count
from ledgerloom.scale import ordinal

ONE = 1 << 40
FAN_IN = 48
WEIGHTS = (5, 2, 1)
LIMIT = 3  # copies of a document, and times its size a source may take
CLASSES_PER_DOUBLING = 8


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target. ``sizes``: source, source_size (one row for each source).

    Weights repeat along the sources by code point (null last). What is above ``limit`` times a source's size is shared again
    by weight among the others until none is above; each round is one global sum.
    """
    named = sizes.withColumn("key", F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))))
    bucket = F.conv(F.hex(F.rpad(F.substring(F.encode("key", "UTF-8"), 1, 3), 3, b"\\x00")), 16, 10).cast("long")
    numbered = ordinal(named.withColumn("all", F.lit(1)), ["all"], bucket, [F.encode("key", "UTF-8")], "number")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = stored(numbered.select("source", "source_size", weight.cast("double").alias("weight"),
                                   F.lit(None).cast("double").alias("capped")), "sources")
    while True:
        total = table.agg(F.sum("source_size"), F.sum("capped"), F.sum(F.when(F.col("capped").isNull(), F.col("weight")))).first()
        rest = float(total[0] or 0) - float(total[1] or 0)
        each = rest / total[2] if total[2] else 0.0
        share = F.col("weight") * F.lit(each)
        over = F.col("capped").isNull() & (share > F.col("source_size") * limit)
        if not table.filter(over).limit(1).count():
            return table.select("source", "source_size", F.coalesce("capped", share).alias("target"))
        table = stored(table.withColumn("capped", F.when(over, (F.col("source_size") * limit).cast("double"))
                                        .otherwise(F.col("capped"))), "sources")


def _draw(a: Column, b: Column, whole: Column) -> Column:
    """A whole number below ``whole``, from a hash of two documents."""
    return F.pmod(F.xxhash64(a["key"], b["key"], F.lit(10)), whole)


def _step(held: Column, unit: Column) -> Column:
    """One pivotal step: the state (residue, settled units) meets the next unit."""
    a, b = held["residue"], unit
    both = a["p"] + b["p"]
    low = both < ONE
    first = F.when(low, _draw(a, b, both) < a["p"]).otherwise(_draw(a, b, 2 * F.lit(ONE) - both) < ONE - b["p"])
    goes_on = F.when(low, first).otherwise(~first)  # whether the first of the two keeps the rest
    rest = F.when(low, both).otherwise(both - ONE)
    keep, done = F.when(goes_on, a["key"]).otherwise(b["key"]), F.when(goes_on, b["key"]).otherwise(a["key"])
    size = F.when(goes_on, a["size"]).otherwise(b["size"])
    settled = F.struct(done.alias("key"), F.when(low, 0).otherwise(1).alias("extra"))
    return F.struct(F.struct(keep.alias("key"), size.alias("size"), rest.alias("p")).alias("residue"),
                    F.array_append(held["settled"], settled).alias("settled"))


def round_pivotal(units: DataFrame) -> DataFrame:
    """key, extra (0 or 1). ``units``: key (a struct that tells units apart), source, size, p (0 <= p < ONE)."""
    doubling = F.log2(F.greatest("size", F.lit(1)).cast("double"))
    rows = units.select("key", "source", "size", "p", (F.floor(doubling * CLASSES_PER_DOUBLING)).cast("int").alias("class"))
    # in a class: groups by hash; their number is halved FAN_IN-fold each round
    counts = stored(rows.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n")), "class-counts")
    most = counts.agg(F.max("n")).first()[0]
    done: list[DataFrame] = []
    if most is None:
        return units.select("key", F.lit(0).alias("extra")).limit(0)
    joined = rows.join(if_small(counts, counts.count()),
                       rows.source.eqNullSafe(counts.source) & (rows["class"] == counts["class"])).select(
        rows.key, rows.source, rows.size, rows.p, rows["class"], "n")
    groups = F.floor((F.col("n") + FAN_IN - 1) / FAN_IN)
    level = joined.withColumn("slot", F.pmod(F.xxhash64("key"), groups))
    while True:
        grouped = level.groupBy("source", "class", "slot").agg(F.sort_array(F.collect_list(F.struct("size", "key", "p"))).alias("all"))
        start = F.struct(F.struct(F.get("all", F.lit(0))["key"].alias("key"), F.get("all", F.lit(0))["size"].alias("size"),
                                  F.get("all", F.lit(0))["p"].alias("p")).alias("residue"),
                         F.filter(F.array(F.struct(F.get("all", F.lit(0))["key"].alias("key"), F.lit(0).alias("extra"))),
                                  lambda x: F.lit(False)).alias("settled"))
        folded = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), start, _step)
        step = stored(grouped.select("source", "class", "slot", folded.alias("f")), "pivotal")
        done.append(step.select(F.explode("f.settled").alias("x")).select("x.key", "x.extra"))
        rest = step.select("source", "class", "slot", "f.residue.key", "f.residue.size", "f.residue.p")
        facts = rest.agg(F.max("slot"), F.max("class"), F.min("class")).first()
        if facts[0] > 0:
            level = rest.withColumn("slot", F.floor(F.col("slot") / FAN_IN))
        elif facts[1] > facts[2]:
            level = rest.withColumn("class", F.floor(F.col("class") / FAN_IN).cast("int"))
        else:  # one unit for each source is left
            lone = rest.select("key", F.when(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(ONE)) < F.col("p"), 1).otherwise(0).alias("extra"))
            out = lone
            for part in done:
                out = out.union(part)
            return out


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for each row of ``docs`` (doc_id, text, source)."""
    rows = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = stored(targets(sizes, weights, limit), "targets")
    n_sources = aims.count()
    same = rows.source.eqNullSafe(aims.source)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = F.round(F.least(ratio, F.lit(float(limit))) * ONE).cast("long")
    held = rows.join(if_small(aims, n_sources), same).select(
        rows.doc_id, rows.source, rows.size, "source_size", "target", wanted.alias("wanted"))
    key = F.struct(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.col("size").alias("size"))
    units = held.withColumn("key", key).groupBy("key").agg(
        F.first("source").alias("source"), F.sum("size").alias("size"), F.first("wanted").alias("wanted"))
    units = stored(units.select("key", "source", "size", F.col("wanted").bitwiseAND(F.lit(ONE - 1)).alias("p")), "units")
    extra = round_pivotal(units.filter("p > 0")).select(
        F.xxhash64("key").alias("h"), F.col("key").alias("unit"), "extra")
    held = held.withColumn("key", key).withColumn("h", F.xxhash64("key"))
    return held.join(extra, (held.h == extra.h) & held.key.eqNullSafe(extra.unit), "left").select(
        held.doc_id, held.source, held.size, "source_size", "target",
        (F.floor(F.col("wanted") / ONE) + F.coalesce("extra", F.lit(0))).cast("int").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    counted = copies(docs, weights, limit).select("doc_id", "source", "size", "copies").distinct()
    counted = counted.filter("copies > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
                                                  F.col("size").alias("__size"), F.col("copies").alias("__copies"))
    counted = stored(counted, "copies")
    # The caller's columns travel as one, so that no name of theirs meets one of ours.
    rows = docs.select(F.struct("*").alias("own"), word_count(F.col("text")).alias("words"))
    return (rows.join(if_small(counted, counted.count(), 500_000), F.col("own.doc_id").eqNullSafe(F.col("__id"))
                      & F.col("own.source").eqNullSafe(F.col("__source")) & (F.col("words") == F.col("__size")))
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("own.*"))
