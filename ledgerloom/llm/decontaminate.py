"""Benchmark decontamination by template windows; DataFrame functions only.

Texts become templates: digit runs, units after them and names (capitalised words inside a sentence) turn into typed
placeholders, everything else is lower-cased words. A benchmark item is its windows of ``WIDTH`` template words. Documents
that share a window with an item are found by a hash join; those are then matched in full: an item is in a document if
``SHARE`` percent of its windows are, and if its slots are filled consistently, that is each value of a slot in the item
stands for one value in the document. Windows are aligned by place (place in the document - place in the item), at all their
places in the document, and one consistent alignment is enough. So a question with other numbers or names is caught, and a text that only has the
same shape with contradicting values is not.

Windows of documents are taken at every ``step``-th word in the search. ``step`` is the length of the shortest run of
consecutive windows that an item above the threshold must have in common with a document, worked out from the items, so
that no match is lost. The second look uses all windows.

Defined results: null or short texts (fewer than ``WIDTH`` template words) match nothing, on either side; a row of the
result for each row of documents and item; repeated rows give repeated results; empty tables give none. Columns that the
operator doesn't name are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import if_small, stored

WIDTH = 5
SHARE = 80

# Placeholder marks (private-use characters) and the units that are told apart after a number.
NAME, NUMBER, UNIT = "", "", ""
UNITS = ("mm cm m km in ft yd mi inch inches feet foot yards mile miles meter meters metre metres kilometers kilometres "
         "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl l liter liters litre "
         "litres gallon gallons ms s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month "
         "months year years hz khz mhz ghz kb mb gb tb w kw v kmh mph usd eur gbp dollar dollars cent cents euro euros "
         "percent degrees").split()


def _marked(text: Column) -> Column:
    """The text with a placeholder mark before each slot value."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NAME}{NUMBER}{UNIT}]", " ")
    text = F.regexp_replace(text, r"(?<=[\p{Ll}\p{Nd},;:][ \t])(?=\p{Lu}\p{Ll})", NAME)
    text = F.regexp_replace(text, r"\p{Nd}+", f" {NUMBER}$0 ")
    return F.regexp_replace(text, rf"(?i)(?<=\p{{Nd}} {{1,2}})(?=(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{Nd}}]))", UNIT)


def _words(marked: Column) -> Column:
    return F.array_remove(F.split(F.lower(marked), rf"[^\p{{L}}\p{{M}}\p{{Nd}}{NAME}{NUMBER}{UNIT}]+"), "")


def _templates(marked: Column) -> Column:
    return _words(F.regexp_replace(marked, rf"([{NAME}{NUMBER}{UNIT}])[\p{{L}}\p{{M}}\p{{Nd}}]+", "$1"))


def _once(expression: Column) -> Column:
    """Evaluate an expression once for a row, before functions that use its value many times."""
    return F.explode(F.array(expression))


def _windows(words: Column, step: int = 1) -> Column:
    """Hashes of the windows that begin at every ``step``-th word."""
    last = F.size(words) - WIDTH
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)),
                                         lambda i: F.xxhash64(F.slice(words, i + 1, WIDTH))))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, words, template, windows of the items that have a window."""
    marked = benchmark.select("item_id", _once(_marked(F.col("text"))).alias("marked"))
    return stored(marked.select("item_id", _once(_words(F.col("marked"))).alias("item_words"),
                                _templates(F.col("marked")).alias("item_template"))
                  .withColumn("item_windows", _windows(F.col("item_template"))).filter("item_windows is not null"), "items")


def _step(items: DataFrame) -> int:
    """Shortest run of windows that a match must have without a gap; an edit inside an item breaks 4 windows or more."""
    n = F.size("item_windows")
    need = F.ceil(n * SHARE / 100)
    runs = F.floor((n - need) / (WIDTH - 1)) + 1
    return int(items.agg(F.min(F.ceil(need / runs))).first()[0] or 1)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, n_slots, verbatim: each item found in each document."""
    items = items_of(benchmark)
    step, n_items = _step(items), items.count()
    keys = items.select("item_id", F.explode(F.array_distinct("item_windows")).alias("window"))
    n_keys = items.agg(F.sum(F.size("item_windows"))).first()[0] or 0
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    searched = (texts.select("key", _once(_templates(_marked(F.col("text")))).alias("words"))
                .select("key", F.explode(_windows(F.col("words"), step)).alias("window")))
    pairs = stored(searched.join(if_small(keys, n_keys), "window").select("key", "item_id").distinct(), "leak-pairs")

    found = (texts.join(if_small(pairs, pairs.count()), "key").select("doc_id", "item_id", _once(_marked(F.col("text"))).alias("marked"))
             .select("doc_id", "item_id", _words(F.col("marked")).alias("words"), _once(_templates(F.col("marked"))).alias("template"))
             .select("doc_id", "item_id", "words", _once(_windows(F.col("template"))).alias("windows"))
             .join(if_small(items, n_items, 20_000), "item_id"))
    n_windows = F.size("item_windows")
    matched = F.size(F.filter("item_windows", lambda w: F.array_contains("windows", w)))
    found = (found.withColumn("n_matched", matched).filter(F.col("n_matched") * 100 >= n_windows * SHARE)
             .select("*", _once(_groups()).alias("groups"))
             .select("*", F.array_max(F.concat(F.array(_by_first_place()), _by_alignment())).alias("best")))
    return (found.filter("best is not null")
            .select("doc_id", "item_id", n_windows.alias("n_windows"), F.col("best.n_matched"), F.col("best.n_slots"), F.col("best.verbatim")))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _slots(offset: Column, at: Column) -> Column:
    """Distinct slot values (i of the item, d of the document) of the item's windows ``at``, ``offset`` places on in the document."""
    places = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(i, i + WIDTH - 1))))
    pairs = F.transform(places, lambda k: F.struct(F.get("item_words", k).alias("i"), F.get("words", k + offset).alias("d")))
    return F.array_distinct(F.filter(pairs, lambda p: F.substring(p["i"], 1, 1).isin(NAME, NUMBER, UNIT)))


def _consistent(slots: Column) -> Column:
    """Each value of the item stands for one value of the document."""
    return F.size(F.array_distinct(F.transform(slots, lambda p: p["i"]))) == F.size(slots)


def _result(at: Column, slots: Column) -> Column:
    return F.struct(F.forall(slots, lambda p: p["i"] == p["d"]).alias("verbatim"), F.size(at).alias("n_matched"),
                    F.size(slots).alias("n_slots"))


def _groups() -> Column:
    """o, at: for each offset (document place - item place), the item's windows that the document has there."""
    hits = F.filter(F.sequence(F.lit(0), F.size("windows") - 1), lambda p: F.array_contains("item_windows", F.get("windows", p)))
    of_item = F.sequence(F.lit(0), F.size("item_windows") - 1)
    same = F.flatten(F.transform(hits, lambda p: F.transform(
        F.filter(of_item, lambda i: F.get("item_windows", i) == F.get("windows", p)), lambda i: F.struct((p - i).alias("o"), i.alias("i")))))

    def cut(all_: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(all_) - 1),
                          lambda k: (k == 0) | (F.get(all_, k)["o"] != F.get(all_, F.greatest(k - 1, F.lit(0)))["o"]))
        return _let(begins, lambda b: F.transform(b, lambda k, n: F.struct(
            F.get(all_, k)["o"].alias("o"),
            F.transform(F.slice(all_, k + 1, F.coalesce(F.get(b, n + 1), F.size(all_)) - k), lambda x: x["i"]).alias("at"))))

    return _let(F.array_sort(same), cut)


def _by_first_place() -> Column:
    """The match with each window at its first place in the document, wherever that is; null if it contradicts itself."""
    every = F.transform(F.sequence(F.lit(0), F.size("item_windows") - 1), lambda i: F.struct(
        i.alias("i"), F.array_position("windows", F.get("item_windows", i)).cast("int").alias("p")))
    there = F.filter(every, lambda x: x["p"] > 0)
    slots = F.array_distinct(F.flatten(F.transform(there, lambda x: _slots(x["p"] - 1 - x["i"], F.array(x["i"])))))
    return _let(slots, lambda s: F.when(_consistent(s), _result(there, s)))


def _by_alignment() -> Column:
    """The matches that begin with the windows at one offset.

    All windows at that offset must be consistent. Windows that it lacks are taken from other offsets, the nearest first, and
    from each offset all of them or none: passages between the parts of a copy, and similar passages elsewhere, do no harm.
    Only offsets with as many windows as the longest run of a match has at least can begin one.
    """
    n = F.size("item_windows")
    need = F.ceil(n * SHARE / 100).cast("int")
    longest = F.ceil(need / (F.floor((n - need) / (WIDTH - 1)) + 1))

    def more(acc: Column, group: Column) -> Column:
        new = F.array_except(group["at"], acc["at"])
        merged = lambda at: F.array_distinct(F.concat(acc["slots"], _slots(group["o"], at)))
        return _let(new, lambda at: F.when(F.size(at) == 0, acc).otherwise(_let(merged(at), lambda s: F.when(
            _consistent(s), F.struct(F.concat(acc["at"], at).alias("at"), s.alias("slots"))).otherwise(acc))))

    def whole(group: Column, slots: Column) -> Column:
        alone = F.struct(group["at"].alias("at"), slots.alias("slots"))
        others = F.array_sort(F.transform(
            F.filter("groups", lambda g: (g["o"] != group["o"]) & (F.size(F.array_except(g["at"], group["at"])) > 0)),
            lambda g: F.struct(F.abs(g["o"] - group["o"]).alias("far"), g["o"].alias("o"), g["at"].alias("at"))))
        return F.when(F.size(group["at"]) == n, F.array(alone)).otherwise(F.array(alone, F.aggregate(others, alone, more)))

    def match(group: Column) -> Column:
        return _let(_slots(group["o"], group["at"]), lambda s: F.when(_consistent(s), F.transform(
            F.filter(whole(group, s), lambda x: F.size(x["at"]) >= need), lambda x: _result(x["at"], x["slots"]))))

    begin = F.filter("groups", lambda g: F.size(g["at"]) >= longest)
    return F.flatten(F.filter(F.transform(begin, match), lambda x: x.isNotNull()))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found; rows are told apart by doc_id and text."""
    rows = docs.select(F.struct("*").alias("own"), F.xxhash64("doc_id", "text").alias("row"))
    found = leaks(rows.select(F.col("row").alias("doc_id"), F.col("own.text").alias("text")), benchmark).select(
        F.col("doc_id").alias("row")).distinct()
    found = stored(found, "leaking")
    return rows.join(if_small(found, found.count()), "row", "left_anti").select("own.*")
