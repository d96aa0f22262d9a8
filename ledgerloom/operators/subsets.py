"""Sets of open invoices whose net amounts add up to a credit, found by halves.

Invoices of one vendor with the same net are one *group*; a *move* takes some of a group (net, number taken). A set is a
row of moves with rising nets. It is found as a lower and an upper half that meet in an equi-join on the amount the
lower half leaves, so that a set of four moves costs a table of pairs, not of triples:

    one or two moves    sum of the row = amount
    2 j - 1 or 2 j      amount - sum of a lower row of j - 1 or j moves = sum of an upper row of j moves

Rows of j moves are written once and serve as both halves. A lower half is left out when as many nets above its last as
are still missing already exceed the rest; a row of moves when it exceeds the vendor's largest amount.

Members are filled in last, for rows of moves that are hits, by joins on (vendor, net): at once where all groups are taken
whole, else move by move, and every partial choice made there is part of a set of the result. Nothing of a vendor is gathered in one task; vendors with many nets are salted.

Counting (``count_subsets``) lists nothing: each group gives a table from sum to number of ways, tables of one vendor are
merged two by two, and the last two meet in an equi-join on what is left of the amount.

Defined results: the amount 0 has the empty set alone, a negative amount none; nets of 0 and below are members like others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.scale import first_per_key, ordinal, spread_nulls, written

# Fixed value: a common bound of sets per amount, the first in search order; used only where a caller asks for it.
MAX_SUBSETS = 250

# Different nets of one vendor per salt.
ROWS_PER_SALT = 1000

_WAYS = "decimal(38,0)"


def _groups(targets: DataFrame, invoices: DataFrame) -> DataFrame:
    """vendor, net, size: how many open invoices have this net; ``largest``: what a set may still add up to in one half;
    ``least``: the vendor's smallest net.

    Nets above the vendor's largest amount are left out, counting what negative nets can take off."""
    most = targets.filter("amount_paise > 0").groupBy("vendor_code").agg(F.max("amount_paise").alias("most"))
    groups = invoices.filter("net_paise IS NOT NULL").groupBy("vendor_code", F.col("net_paise").alias("net")).agg(
        F.count(F.lit(1)).alias("size"))
    below = groups.groupBy("vendor_code").agg(F.sum(F.least(F.col("net") * F.col("size"), F.lit(0))).alias("below"),
                                              F.min("net").alias("least"))
    limit = most.join(below, "vendor_code").select("vendor_code", (F.col("most") - F.col("below")).alias("largest"), "least")
    return groups.join(limit, "vendor_code").filter("net <= largest")


def _taken(low: int) -> Column:
    """How many of a group a set can take, from ``low`` on."""
    most = F.when(F.col("net") > 0, F.least("size", F.floor(F.col("largest") / F.col("net")).cast("bigint"))).otherwise(F.col("size"))
    return F.explode(F.sequence(F.lit(low).cast("bigint"), most))


def _with_salts(groups: DataFrame, salts: int | None) -> DataFrame:
    """``groups`` with ``salts``: into how many parts work on each vendor is cut."""
    if salts is not None:
        return groups.withColumn("salts", F.lit(salts))
    sizes = groups.groupBy("vendor_code").agg((1 + F.floor(F.count(F.lit(1)) / ROWS_PER_SALT)).cast("int").alias("salts"))
    return groups.join(sizes, "vendor_code")


def _salted(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.col("salts")).cast("int"))


def _each_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _rows_of_one(groups: DataFrame) -> DataFrame:
    """Rows of one move."""
    one = groups.withColumn("taken", _taken(1))
    return one.select("vendor_code", "salts", "largest", "least", F.array(F.struct("net", "taken", "size")).alias("moves"),
                      (F.col("net") * F.col("taken")).alias("sum"), F.col("net").alias("first"), F.col("net").alias("last"))


def _longer(rows: DataFrame, one: DataFrame, moves: int) -> DataFrame:
    """Rows of ``moves`` moves: those of ``rows`` with one more, of a larger net.

    Rows of three or more are halves of sets with at least one move less on the other side."""
    beside = F.lit(0) if moves < 3 else (moves - 1) * F.greatest("least", F.lit(0))
    move = _salted(one, "moves").select(
        "vendor_code", "salt", F.col("moves").alias("next"), F.col("sum").alias("more"), F.col("last").alias("new"))
    joined = _each_salt(rows.withColumn("keep", F.col("salts"))).join(move, ["vendor_code", "salt"]).filter(
        (F.col("new") > F.col("last")) & (F.col("sum") + F.col("more") + beside <= F.col("largest")))
    return joined.select("vendor_code", F.col("keep").alias("salts"), "largest", "least", F.concat("moves", "next").alias("moves"),
                         (F.col("sum") + F.col("more")).alias("sum"), "first", F.col("new").alias("last"))


def _halves(amounts: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows as lower halves of each amount, with what they leave of it: at least as many moves of larger nets are missing."""
    half = _salted(rows, "moves").select("vendor_code", "salt", "n", "moves", "sum", "last")
    possible = (F.col("last") < 0) | (F.col("n") * (F.col("last") + 1) <= F.col("amount_paise") - F.col("sum"))
    return amounts.join(half, ["vendor_code", "salt"]).filter(possible).select(
        "vendor_code", "amount_paise", (F.col("amount_paise") - F.col("sum")).alias("sum"), F.col("n").alias("j"),
        F.col("moves").alias("lower"), "last")


def moves_of(targets: DataFrame, invoices: DataFrame, max_moves: int | None = None, salts: int | None = None) -> DataFrame:
    """(vendor_code, amount_paise, moves) of all sets for amounts above 0; with ``max_moves``, of so many nets at most."""
    wanted = written(targets.select("vendor_code", "amount_paise").distinct().filter("amount_paise > 0"))
    groups = _with_salts(_groups(wanted, invoices), salts)
    one = written(_rows_of_one(groups))
    vendors = one.groupBy("vendor_code").agg(F.max("salts").alias("salts"))
    levels = [one.withColumn("n", F.lit(1))]
    rows = one
    while max_moves is None or 2 * len(levels) < max_moves or len(levels) < min(max_moves, 2):
        rows = written(_longer(rows, one, len(levels) + 1))
        if rows.isEmpty():
            break
        levels.append(rows.withColumn("n", F.lit(len(levels) + 1)))
    every = reduce(DataFrame.unionByName, levels)
    amounts = _each_salt(wanted.join(vendors, "vendor_code"))
    nothing = wanted.select("vendor_code", "amount_paise", F.col("amount_paise").alias("sum"), F.lit(0).alias("j"), F.expr(
        "cast(array() AS array<struct<net:bigint,taken:bigint,size:bigint>>)").alias("lower"), F.lit(None).cast("bigint").alias("last"))
    left = nothing.unionByName(_halves(amounts, every)) if len(levels) > 1 else nothing
    upper = every.select("vendor_code", "sum", "n", "moves", "first")
    # One and two moves are rows themselves; further on the upper half has as many moves as the lower one, or one more.
    fits = F.when(F.col("j") == 0, F.col("n") <= 2).otherwise(
        (F.col("first") > F.col("last")) & ((F.col("n") == F.col("j") + 1) | ((F.col("n") == F.col("j")) & (F.col("n") > 1))))
    if max_moves is not None:
        fits = fits & (F.col("n") + F.col("j") <= max_moves)
    return left.join(upper, ["vendor_code", "sum"]).filter(fits).select(
        "vendor_code", "amount_paise", F.concat("lower", "moves").alias("moves"))


def _choices(hits: DataFrame, invoices: DataFrame, cap: int | None) -> DataFrame:
    """vendor, net, taken, and one choice of so many invoices: path (net, no), dates, supplier of the first.

    Choices of more than one are made one invoice at a time in order, and only where enough invoices follow, so that each
    beginning belongs to a choice. With ``cap`` the first so many in order are kept."""
    needed = hits.select("vendor_code", F.explode("moves").alias("m")).select("vendor_code", "m.net", "m.taken").distinct()
    rows = invoices.select("vendor_code", F.col("net_paise").alias("net"), F.struct(
        F.col("net_paise").alias("net"), F.col("invoice_number").alias("no")).alias("member"),
        F.col("document_date").alias("date"), F.col("supplier_legal_name").alias("supplier"))
    single = needed.filter("taken = 1").join(rows, ["vendor_code", "net"])
    out = single.select("vendor_code", "net", "taken", F.array("member").alias("path"), F.array("date").alias("dates"), "supplier")
    many = needed.filter("taken > 1")
    most = many.agg(F.max("taken")).first()[0]
    if most is None:
        return out
    in_order = Window.partitionBy("vendor_code", "net").orderBy("member.no")
    placed = rows.join(many.select("vendor_code", "net").distinct(), ["vendor_code", "net"]).withColumn(
        "place", F.row_number().over(in_order))
    sized = placed.groupBy("vendor_code", "net").agg(F.count(F.lit(1)).alias("size"))
    placed, state = written(placed), many.join(sized, ["vendor_code", "net"])
    whole = placed.join(state.filter("taken = size"), ["vendor_code", "net"]).groupBy("vendor_code", "net", "taken").agg(
        F.array_sort(F.collect_list(F.struct("place", "member", "date"))).alias("all"))
    out = out.unionByName(whole.select("vendor_code", "net", "taken", F.col("all.member").alias("path"), F.col("all.date").alias("dates"),
                                       F.lit(None).cast("string").alias("supplier")))
    empty = F.expr("cast(array() AS array<struct<net:bigint,no:string>>)")
    state = state.filter("taken < size").select("vendor_code", "net", "taken", "size", F.lit(0).alias("last"), empty.alias("path"),
                                                F.expr("cast(array() AS array<date>)").alias("dates"))
    for chosen in range(1, most + 1):
        fits = (F.col("place") > F.col("last")) & (F.col("place") <= F.col("size") - F.col("taken") + chosen)
        state = state.filter(F.col("taken") >= chosen).join(placed.drop("supplier"), ["vendor_code", "net"]).filter(fits).select(
            "vendor_code", "net", "taken", "size", F.col("place").alias("last"), F.array_append("path", F.col("member")).alias("path"),
            F.array_append("dates", F.col("date")).alias("dates"))
        if cap:
            state = first_per_key(state, ["vendor_code", "net", "taken"], [F.asc("path")], cap)
        state = written(state)
        if state.isEmpty():
            break
        out = out.unionByName(state.filter(F.col("taken") == chosen).select(
            "vendor_code", "net", "taken", "path", "dates", F.lit(None).cast("string").alias("supplier")))
    return out


def _whole_groups(hits: DataFrame, invoices: DataFrame) -> DataFrame:
    """The sets of hits that take each of their groups whole: all invoices with these nets."""
    rows = invoices.select("vendor_code", F.col("net_paise").alias("net"), F.struct(
        F.col("net_paise").alias("net"), F.col("invoice_number").alias("no"), F.col("document_date").alias("date"),
        F.col("supplier_legal_name").alias("supplier")).alias("member"))
    each = hits.select("vendor_code", "amount_paise", "moves", F.explode("moves.net").alias("net")).join(rows, ["vendor_code", "net"])
    sets = each.groupBy("vendor_code", "amount_paise", "moves").agg(F.array_sort(F.collect_list("member")).alias("all"))
    return sets.select("vendor_code", "amount_paise", F.transform("all", lambda m: F.struct(m["net"].alias("net"), m["no"].alias("no"))).alias("path"),
                       F.col("all.date").alias("dates"), F.col("all")[0]["supplier"].alias("supplier"))


def _members(hits: DataFrame, invoices: DataFrame, cap: int | None) -> DataFrame:
    """All sets of the hits of one move or more."""
    hits = written(hits.withColumn("whole", F.forall("moves", lambda m: m["taken"] == m["size"])))
    found = _whole_groups(hits.filter("whole"), invoices)
    parts = hits.filter("NOT whole").drop("whole")
    longest = parts.agg(F.max(F.size("moves"))).first()[0]
    return found if longest is None else found.unionByName(_move_by_move(parts, invoices, cap, longest))


def _move_by_move(hits: DataFrame, invoices: DataFrame, cap: int | None, longest: int) -> DataFrame:
    """The sets of hits that choose from a group, their moves filled in one after the other."""
    state = hits.withColumns({"path": F.expr("cast(array() AS array<struct<net:bigint,no:string>>)"),
                              "dates": F.expr("cast(array() AS array<date>)"), "supplier": F.lit(None).cast("string")})

    def key(vendor: Column, move: Column) -> Column:
        return F.concat_ws("|", vendor, move["net"].cast("string"), move["taken"].cast("string"))

    choices = written(_choices(hits, invoices, cap)).select(
        key(F.col("vendor_code"), F.struct("net", "taken")).alias("key"), F.col("path").alias("c_path"), F.col("dates").alias("c_dates"),
        F.col("supplier").alias("c_supplier"))
    for i in range(longest):
        move = F.when(F.size("moves") > i, F.get("moves", F.lit(i)))
        own = F.when(move.isNotNull(), key(F.col("vendor_code"), move))
        state = (state.withColumn("key", spread_nulls(own, F.col("vendor_code"), F.col("amount_paise"), F.to_json("path")))
                 .join(choices, "key", "left").select(
                     "vendor_code", "amount_paise", "moves",
                     F.when(F.col("c_path").isNull(), F.col("path")).otherwise(F.concat("path", "c_path")).alias("path"),
                     F.when(F.col("c_dates").isNull(), F.col("dates")).otherwise(F.concat("dates", "c_dates")).alias("dates"),
                     F.coalesce("supplier", "c_supplier").alias("supplier")))
    return state.drop("moves")


def find_subsets(targets: DataFrame, invoices: DataFrame, max_size: int | None = None, salts: int | None = None,
                 cap: int | None = None) -> DataFrame:
    """Sets per (vendor_code, amount_paise) of ``targets``; with ``cap``, the first so many in search order.

    Columns: vendor_code, amount_paise, size, members (sorted), dates, supplier (single-member sets only) and
    path, the members with their nets in ascending (net, invoice_number) order, the order the search meets sets in.
    ``max_size=None`` finds sets of any size. ``salts`` fixes the salts per vendor; by default they follow from the
    vendor's different nets.
    """
    invoices = written(invoices.select("vendor_code", "net_paise", "invoice_number", "document_date", "supplier_legal_name"))
    hits = moves_of(targets, invoices, max_size, salts)
    if max_size is not None:
        total = F.aggregate("moves", F.lit(0).cast("bigint"), lambda acc, m: acc + m["taken"])
        hits = hits.filter(total <= max_size)
    nothing = targets.filter("amount_paise = 0").select("vendor_code", "amount_paise").distinct().withColumns({
        "path": F.expr("cast(array() AS array<struct<net:bigint,no:string>>)"), "dates": F.expr("cast(array() AS array<date>)"),
        "supplier": F.lit(None).cast("string")})
    found = _members(hits, invoices, cap).unionByName(nothing)
    return _shown(first_in_search_order(found, cap)) if cap else _shown(found)


def first_in_search_order(found: DataFrame, cap: int = MAX_SUBSETS) -> DataFrame:
    """The first ``cap`` sets per amount, in the order the search meets them."""
    return first_per_key(found, ["vendor_code", "amount_paise"], [F.asc("path")], cap)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("vendor_code", "amount_paise", F.size("path").alias("size"),
                        F.array_sort("path.no").alias("members"), "dates",
                        F.when(F.size("path") == 1, F.col("supplier")).alias("supplier"), "path")


def _ways() -> Column:
    """How many choices there are of ``taken`` out of ``size``."""
    step = lambda acc, i: F.floor(acc * (F.col("size") - F.col("taken") + i) / i).cast(_WAYS)
    return F.when(F.col("taken") == 0, F.lit(1).cast(_WAYS)).otherwise(
        F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest("taken", F.lit(1))), F.lit(1).cast(_WAYS), step))


def count_subsets(targets: DataFrame, invoices: DataFrame, salts: int | None = None) -> DataFrame:
    """(vendor_code, amount_paise, subsets) of the amounts that have a set: numbers of sets, none of them listed.

    Numbers of up to 38 digits; a vendor's tables hold each sum up to its largest amount once."""
    wanted = written(targets.select("vendor_code", "amount_paise").distinct())
    groups = _with_salts(_groups(wanted, invoices), salts)
    spread = F.xxhash64("net")
    placed = ordinal(groups, ["vendor_code"], F.shiftright(spread, 54), [spread, F.col("net")], "node")
    tables = written(placed.withColumn("taken", _taken(0)).select(
        "vendor_code", "salts", "largest", (F.col("node") - 1).alias("node"), (F.col("net") * F.col("taken")).alias("sum"), _ways().alias("ways")))
    nodes = (tables.agg(F.max("node")).first()[0] or 0) + 1
    while nodes > 2:
        left = _each_salt(tables.filter("node % 2 = 0").withColumn("keep", F.col("salts")).withColumn("node", F.expr("node div 2")))
        right = _salted(tables.filter("node % 2 = 1"), "sum").select(
            "vendor_code", "salt", F.expr("node div 2").alias("node"), F.col("sum").alias("more"), F.col("ways").alias("times"))
        merged = left.join(right, ["vendor_code", "salt", "node"]).filter(F.col("sum") + F.col("more") <= F.col("largest")).select(
            "vendor_code", F.col("keep").alias("salts"), "largest", "node", (F.col("sum") + F.col("more")).alias("sum"),
            (F.col("ways") * F.col("times")).cast(_WAYS).alias("ways"))
        # A table without a partner goes on as it is.
        odd = tables.groupBy("vendor_code").agg(F.max("node").alias("top")).filter("top % 2 = 0")
        alone = tables.join(odd, (tables["vendor_code"] == odd["vendor_code"]) & (tables["node"] == odd["top"]), "left_semi").withColumn(
            "node", F.expr("node div 2"))
        tables = written(merged.unionByName(alone.select(*merged.columns)).groupBy("vendor_code", "salts", "largest", "node", "sum").agg(
            F.sum("ways").cast(_WAYS).alias("ways")))
        nodes = (nodes + 1) // 2
    first = _salted(tables.filter("node = 0"), "sum").select("vendor_code", "salt", "sum", "ways")
    # The second table of a vendor, or the one way to take nothing.
    vendors = tables.groupBy("vendor_code").agg(F.max("salts").alias("salts"), F.max("node").alias("top"))
    second = tables.filter("node = 1").select("vendor_code", "sum", F.col("ways").alias("times")).unionByName(
        vendors.filter("top = 0").select("vendor_code", F.lit(0).cast("bigint").alias("sum"), F.lit(1).cast(_WAYS).alias("times")))
    left = _each_salt(wanted.filter("amount_paise > 0").join(vendors.drop("top"), "vendor_code")).join(first, ["vendor_code", "salt"]).select(
        "vendor_code", "amount_paise", (F.col("amount_paise") - F.col("sum")).alias("sum"), "ways")
    counted = left.join(second, ["vendor_code", "sum"]).groupBy("vendor_code", "amount_paise").agg(
        F.sum((F.col("ways") * F.col("times")).cast(_WAYS)).cast(_WAYS).alias("subsets"))
    return counted.unionByName(wanted.filter("amount_paise = 0").select("vendor_code", "amount_paise", F.lit(1).cast(_WAYS).alias("subsets")))
