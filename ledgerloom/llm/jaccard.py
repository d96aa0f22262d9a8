"""N-gram Jaccard join by a token-group matrix.

Documents are sets of distinct word shingles. Equal sets are one class with one representative. Representatives are put
into groups of similar ones: those with an equal minimum hash, then groups with most of their rare tokens in common are made
one, and families with the small groups that can have links to them, so that a family of near copies is one group. A group holds about ``GROUP_TOKENS`` shingles; larger ones are split by hash.
The token-group matrix holds the tokens of each group's union; a group needs to be looked at by a document only if their
overlap can reach the threshold. Two filters bound it:

* every pair above the threshold shares ``k`` of the first ``n - ceil(t n) + k`` shingles of both sets in one common order
  (rare first), with ``k = 1 + n / EXTRA`` of the smaller set, so that only these tokens go into the distributed matrix; a
  document looks at a group if it shares ``k`` of them with the group's union, with the smallest ``n`` that a partner can have;
* where documents of two groups look at each other, those whose overlap with the union of the others is below ``t n`` are left
  out, and the groups are opened only if both sides have documents left.

Opened groups are compared exactly. Within them one link suffices to join what it connects: documents already connected
aren't compared again, so that many near copies don't cost all their pairs.

The order is by a sketch of how many documents have a shingle (``SKETCH_BITS`` counters filled from all documents), then
by hash. Any order gives the same links; the sketch only keeps passages that many documents share out of the matrix.

Defined results: a null or wordless text has the empty set and links to nothing; fewer words than a shingle make one
shingle of all words; rows with equal doc_id are one node; a row with null doc_id takes the component of a document with
an equal set, else null; ties don't arise (components don't depend on order); no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.arrays import U64, chunks, mix, release
from ledgerloom.llm.components import connected
from ledgerloom.llm.shared import if_small, stored

SKETCH_BITS = 20
SLICES = 16
GROUP_TOKENS = 1_500_000
EXTRA = 20  # a twentieth of a set more goes into the matrix, and so many tokens more must be common
ALIKE = 1.5  # times as many tokens as a document needs to look at a group make two groups one
FAMILY = 10  # times as many documents make a group a family for another one
ROUNDS = 2  # times that rows of the matrix which can't count are left out; any number gives the same links
ACTIVE_ROWS = 500_000  # rows of a few numbers that may be broadcast


def shingle_sets(texts, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, first = texts.words()
    word = texts.hashes(starts, ends)
    n = np.diff(first)

    def run(at: np.ndarray, length: int) -> np.ndarray:
        out = np.full(len(at), length, dtype=U64)
        with np.errstate(over="ignore"):
            for j in range(length):
                out = mix(out * U64(0x9E3779B97F4A7C15) + word[at + j])
        return out

    full = run(np.arange(max(len(word) - width + 1, 0)), width)
    sets = [np.unique(full[a:a + k - width + 1]) if k >= width else np.empty(0, dtype=U64) for a, k in zip(first, n)]
    for length in range(1, width):
        some = np.flatnonzero(n == length)
        for i, h in zip(some, run(first[some], length)):
            sets[i] = np.array([h], dtype=U64)
    return sets


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U64(64 - SKETCH_BITS)).astype(np.int64)


def _sketching(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                sets = shingle_sets(texts, width)
                if sets:
                    counts += np.bincount(_bucket(np.concatenate(sets)), minlength=len(counts)).astype(np.uint32)
        yield pa.RecordBatch.from_pydict({
            "slice": pa.array(range(SLICES), pa.int32()),
            "counts": pa.array([c.tobytes() for c in np.split(counts, SLICES)], pa.binary())})
    return run


def _add_slices(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_buffer(), dtype=np.uint32).astype(np.uint64) for c in table.column("counts"))
    return pa.table({"slice": table.column("slice")[:1],
                     "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How many documents have a shingle of each bucket; ``2 ** SKETCH_BITS`` numbers."""
    rows = (docs.select("text").mapInArrow(_sketching(width), "slice int, counts binary")
            .groupBy("slice").applyInArrow(_add_slices, "slice int, counts binary").orderBy("slice").collect())
    return np.concatenate([np.frombuffer(r["counts"], dtype=np.uint32) for r in rows]
                          or [np.zeros(1 << SKETCH_BITS, dtype=np.uint32)])


def _describing(held, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                sets = shingle_sets(texts, width)
                digest, key, prefix = [], [], []
                for s in sets:
                    if not len(s):
                        digest.append(None)
                        key.append(None)
                        prefix.append(None)
                        continue
                    need = -(-percent * len(s) // 100)
                    take = len(s) - need + 1 + len(s) // EXTRA
                    order = np.lexsort((s, counts[_bucket(s)]))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    prefix.append(s[order[:take]].view(np.int64))
                    # passages that many documents share would make groups of unlike documents
                    key.append(int(mix(s[order[:(len(s) + 1) // 2]]).min() >> U64(1)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(part.schema.get_field_index("doc_id")),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array(digest, pa.binary()),
                    "key": pa.array(key, pa.int64()), "prefix": pa.array(prefix, pa.list_(pa.int64()))})
    return run


_DESCRIBED = "doc_id long, n_shingles long, digest binary, key long, prefix array<long>"


def _setting(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                yield pa.RecordBatch.from_pydict({
                    "rep": part.column(part.schema.get_field_index("rep")),
                    "tokens": pa.array([s.tobytes() for s in shingle_sets(texts, width)], pa.binary())})
    return run


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what all links connect.

    From each document in turn the overlaps with all documents not reached yet are counted through an inverted index,
    which is built anew whenever half of those in it have been reached.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    _, code = np.unique(np.concatenate(sets) if n else np.empty(0, U64), return_inverse=True)
    cut = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(n), size)
    left = np.ones(n, dtype=bool)
    built, index, postings = -1, None, None
    links = []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            remaining = int(left.sum())
            if not remaining:
                return links
            if built < 0 or remaining * 2 <= built:
                keep = left[owner]
                order = np.argsort(code[keep], kind="stable")
                postings = owner[keep][order]
                index = np.concatenate([[0], np.cumsum(np.bincount(code[keep], minlength=int(code.max()) + 1))])
                built = remaining
            at = queue.pop()
            mine = code[cut[at]:cut[at + 1]]
            begin, count = index[mine], index[mine + 1] - index[mine]
            total = int(count.sum())
            if not total:
                continue
            where = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(total)
            others, inverse = np.unique(postings[where], return_inverse=True)
            both = np.bincount(inverse)
            hit = others[left[others] & (100 * both >= percent * (size[at] + size[others] - both))]
            left[hit] = False
            links += [(at, int(h)) for h in hit]
            queue += hit.tolist()
    return links


def _comparing(percent: int):
    def run(table: pa.Table) -> pa.Table:
        groups = table.column("group").to_numpy()
        reps = table.column("rep").to_numpy()
        sets = [np.frombuffer(t.as_buffer(), dtype=U64) for t in table.column("tokens")]
        names = np.unique(groups)
        if len(names) > 1:  # two groups: leave out documents that can't reach the threshold in the other
            for _ in range(2):
                unions = {g: np.unique(np.concatenate([s for s, x in zip(sets, groups) if x == g])) for g in names}
                other = {names[0]: unions[names[1]], names[1]: unions[names[0]]}
                stay = [i for i, s in enumerate(sets)
                        if 100 * int(np.isin(s, other[groups[i]], assume_unique=True).sum()) >= percent * len(s)]
                groups, reps, sets = groups[stay], reps[stay], [sets[i] for i in stay]
                names = np.unique(groups)
                if len(names) < 2:
                    return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        links = spanning_links(sets, percent)
        release()
        return pa.table({"a": pa.array([int(reps[i]) for i, _ in links], pa.int64()),
                         "b": pa.array([int(reps[j]) for _, j in links], pa.int64())})
    return run


def describe(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, group key, and the tokens for the matrix, a row for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    held = docs.sparkSession.sparkContext.broadcast(sketch(rows, width))
    return stored(rows.mapInArrow(_describing(held, width, percent), _DESCRIBED), "described")


def _split(rows: DataFrame) -> DataFrame:
    """``rows`` (rep, n, key) with ``group``: the key, split by hash where it has many shingles."""
    weight = rows.groupBy("key").agg(F.sum("n").alias("weight"))
    part = F.pmod(F.xxhash64("rep"), (F.col("weight") / GROUP_TOKENS).cast("long") + 1)
    return rows.join(weight, "key").withColumn("group", F.shiftrightunsigned(F.xxhash64("key", part), 20)).drop("weight")


def _merge(hashed: DataFrame, merged: DataFrame) -> DataFrame:
    """rep, group after components of alike groups (node, component) have become one group each.

    Components with many shingles are dealt to several groups, but never the documents of one group before: tokens that only
    these have in common are not in the matrix.
    """
    weights = hashed.groupBy("group").agg(F.sum("n").alias("weight"))
    nodes = merged.join(weights, merged.node == weights.group).select("node", "component", "weight")
    totals = nodes.groupBy("component").agg(F.sum("weight").alias("total"))
    part = F.pmod(F.xxhash64("node"), (F.col("total") / GROUP_TOKENS).cast("long") + 1)
    placed = nodes.join(totals, "component").select(
        F.col("node").alias("group"), F.shiftrightunsigned(F.xxhash64("component", part), 20).alias("placed"))
    return hashed.join(placed, "group", "left").select("rep", F.coalesce("placed", "group").alias("group"))


def _alike(shared: DataFrame, hashed: DataFrame) -> DataFrame:
    """Pairs (a, b) of groups to be made one: those with most of their matrix tokens in common, and a family of near copies with
    each much smaller group that can have a link to it.

    A group beside a family would be looked at by every document of the family, and there can be as many of them as
    the family has documents; within one group a document that is connected isn't compared again."""
    matrix = shared.groupBy("token", "group").agg(F.min("least").alias("least"))
    common = (matrix.alias("x").join(matrix.alias("y"), "token").filter("x.group < y.group")
              .groupBy(F.col("x.group").alias("a"), F.col("y.group").alias("b"))
              .agg(F.count(F.lit(1)).alias("common"), F.min("x.least").alias("a_least"), F.min("y.least").alias("b_least")))
    most = F.col("common") >= ALIKE * F.least("a_least", "b_least")
    linked = F.col("common") >= F.greatest("a_least", "b_least")
    possible = stored(common.filter(most | linked).select("a", "b", most.alias("most")), "alike")
    sizes = hashed.groupBy("group").agg(F.count(F.lit(1)).alias("docs"))
    beside = (possible.filter("NOT most").join(sizes.select(F.col("group").alias("a"), F.col("docs").alias("a_docs")), "a")
              .join(sizes.select(F.col("group").alias("b"), F.col("docs").alias("b_docs")), "b")
              .filter(F.greatest("a_docs", "b_docs") >= FAMILY * F.least("a_docs", "b_docs")))
    return possible.filter("most").select("a", "b").union(beside.select("a", "b"))


def _lasting(rows: DataFrame) -> DataFrame:
    """``rows`` (token, rep, group, least) that can count: tokens of several groups, in documents that have ``least`` of them.

    No link between groups is lost: both documents have ``least`` tokens in common, which are tokens of both groups. Words
    that documents share by chance go, which are most of the rows.
    """
    for _ in range(ROUNDS):
        several = rows.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi")
        rows = rows.join(several.select("token"), "token")
        enough = rows.groupBy("rep").agg(F.countDistinct("token").alias("have"), F.min("least").alias("fewest"))
        rows = rows.join(enough.filter("have >= fewest").select("rep"), "rep")
    return rows


def links_of(docs: DataFrame, described: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between representatives of different sets, enough to connect all that links connect."""
    least = 1 + F.floor(F.floor(F.col("n_shingles") * percent / 100) / EXTRA)
    classes = stored(described.filter("digest is not null and doc_id is not null").groupBy("digest", "key", "n_shingles")
                     .agg(F.min("doc_id").alias("rep")).withColumn("least", least).withColumnRenamed("n_shingles", "n"), "classes")
    hashed = stored(_split(classes).drop("key"), "hashed")
    first = hashed.select("digest", F.col("rep").alias("doc_id"), "group", "least")
    postings = (described.select("digest", "doc_id", "prefix").join(if_small(first, hashed.count(), ACTIVE_ROWS), ["digest", "doc_id"])
                .select(F.col("doc_id").alias("rep"), "group", "least", F.explode("prefix").alias("token")).repartition("token"))
    several = postings.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi")
    shared = stored(postings.join(several.select("token"), "token"), "shared")

    shared = stored(_lasting(shared), "lasting")

    grouped = stored(_merge(hashed, connected(_alike(shared, hashed))), "grouped")

    sides = stored(_lasting(shared.drop("group").join(grouped, "rep")), "sides")
    matrix = sides.select("token", F.col("group").alias("other")).distinct()
    hits = (sides.join(matrix, "token").filter("group <> other").groupBy("rep", "group", "least", "other")
            .agg(F.count(F.lit(1)).alias("common")).filter("common >= least")
            .select("rep", "group", F.xxhash64(F.least("group", "other"), F.greatest("group", "other")).alias("cell")))
    hits = stored(hits, "hits")
    met = hits.groupBy("cell").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("cell")
    own = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("docs")).filter("docs > 1").select("group")
    opened = stored(hits.join(met, "cell").select("rep", "group", "cell").union(
        grouped.join(own, "group").select("rep", "group", F.xxhash64("group").alias("cell"))), "opened")

    active = stored(opened.select("rep").distinct(), "active")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    chosen = texts.join(if_small(active, active.count(), ACTIVE_ROWS), "rep")
    sets = chosen.mapInArrow(_setting(width), "rep long, tokens binary").filter("octet_length(tokens) > 0")
    return (sets.join(if_small(opened, opened.count(), ACTIVE_ROWS), "rep").select("cell", "group", "rep", "tokens")
            .groupBy("cell").applyInArrow(_comparing(percent), "a long, b long"))


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) for each row of ``docs``.

    Two documents link when 100 * intersection >= percent * union of their sets of ``width``-word shingles.
    """
    described = describe(docs, width, percent)
    joined = connected(links_of(docs, described, width, percent))
    classes = described.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    named = classes.join(joined, F.col("rep") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "rep").alias("found"))
    return (described.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
            .select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: the one with the smallest doc_id.

    Of rows with equal doc_id and text one stays, so of rows without a doc_id one for each text.
    """
    found = jaccard_components(docs, width, percent)
    gone = stored(found.filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    kept = docs.join(if_small(gone, gone.count(), ACTIVE_ROWS), "doc_id", "left_anti")
    again = stored(kept.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__id")), "repeated")
    n = again.count()
    if not n:
        return kept
    once = kept.join(if_small(again, n, ACTIVE_ROWS), kept.doc_id.eqNullSafe(again["__id"]), "left_anti")
    several = kept.join(if_small(again, n, ACTIVE_ROWS), kept.doc_id.eqNullSafe(again["__id"]), "left_semi")
    return once.union(several.withColumn("__text", F.md5(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "__text"])
                      .drop("__text"))
