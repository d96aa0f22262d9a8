"""LM scoring, Jaccard join, token files and toxicity against brute force, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard, lmscore, rans, tokenfile, toxicity
from ledgerloom.llm.arrays import Texts
from ledgerloom.llm.deobfuscate import CharModel, disguised, restore, trigrams

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_rows():
    rng = random.Random(5)
    vocab = ["the", "Of", "thé", "a", "word", "x1", "end"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30))), "en", "s", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, " \n\t ", "en", "s", 3), (None, "the of", "en", "s", 1)]
    rows += [(103, "long " * 30000, "en", "s", 1)] + rows[:3] + rows[:3]
    return rows


def test_lm_counts_and_base_score(spark, make):
    rows = odd_rows()
    got = lmscore.score_documents(make(rows, DOCS)).collect()
    assert len(got) == len(rows)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    counts = Counter()
    for d, t, *_ in rows:
        if not held(d):
            counts.update(WORD.findall(low(t)) + ["\n"])
    total, types = sum(counts.values()), len(counts)
    want = sorted((repr(d), held(d), len(ts), sum(c > 0 for c in cs),
                   round(sum(math.log10((c + 0.1) / (total + 0.1 * (types + 1))) for c in cs), 6))
                  for d, t, *_ in rows for ts in [WORD.findall(low(t)) + ["\n"]] for cs in [[counts[x] for x in ts]])
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total} and all(r.score < 0 for r in got)


def test_lm_in_passes_is_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text", (F.col("doc_id") % 5 == 0).alias("held_out"))
    old, lmscore.SEGMENT_BYTES = lmscore.SEGMENT_BYTES, 100_000
    try:
        segments, n = lmscore.train(rows)
    finally:
        lmscore.SEGMENT_BYTES = old
    assert n > 2
    one = {r.doc_id: r for r in lmscore.score(rows, segments, n).collect()}
    for r in lmscore.score(rows, segments, n, broadcast_mb=0).collect():
        assert r.score == pytest.approx(one[r.doc_id].score) and r.base_score == pytest.approx(one[r.doc_id].base_score)
        assert r.n_known == one[r.doc_id].n_known
    held = [r for r in one.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_in_parts_is_the_same(spark, monkeypatch):
    """The driver holds one part of the model at once, and texts are still scored in one pass."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(False).alias("held_out"))
    monkeypatch.setattr(lmscore, "SEGMENT_BYTES", 100_000)
    segments, n = lmscore.train(rows)
    made, model = [], lmscore._model
    monkeypatch.setattr(lmscore, "_model", lambda some, number: made.append(some.count()) or model(some, number))
    one = {r.doc_id: r for r in lmscore.score(rows, segments, n).collect()}
    assert made == [segments.count()]
    monkeypatch.setattr(lmscore, "PART_MB", 0)
    scored = lmscore.score(rows, segments, n)
    assert made[1:] == [1] * segments.count() and n > 4
    assert {r.doc_id: r for r in scored.collect()} == one


def test_lm_filter_levels():
    keys = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.array([1 + i % 700 for i in range(4000)])
    size, bits = lmscore.build_bits(keys, counts)
    level = lmscore.Filter({0: (size, bits)}, 1).level(keys)
    assert (lmscore.lower_count(level) >= lmscore.LEVELS[np.searchsorted(lmscore.LEVELS, counts, side="right") - 1]).all()
    exact = (lmscore.lower_count(level) <= counts) & (counts <= lmscore.upper_count(level))
    assert exact.mean() > 0.95
    absent = lmscore.Filter({0: (size, bits)}, 1).level(keys + np.uint64(12345))
    assert (absent > 0).mean() < 0.05


def test_lm_empty(make):
    assert lmscore.score_documents(make([], DOCS)).collect() == []


def components(sets, percent):
    ids = list(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, width):
    words = WORD.findall(low(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def near_copies():
    rng = random.Random(9)
    rows, at = [], 0
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 99)}"
            rows.append((at, " ".join(words), "en", "s", 1))
            at += 1
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(at + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(70)), "en", "s", 1) for i in range(30)]
    return rows


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard_components(make, width, percent):
    rows = near_copies() + [(900, None, None, None, None), (901, "", "", "", 0), (902, "one Two", "", "", 0),
                            (903, "ONE two", "", "", 0), (904, "two one", "", "", 0)]
    sets = {d: shingles(t, width) for d, t, *_ in rows}
    want = components(sets, percent)
    old, jaccard.GROUP_TOKENS = jaccard.GROUP_TOKENS, 2000  # many groups
    try:
        got = {r.doc_id: r for r in jaccard.jaccard_components(make(rows, DOCS), width, percent).collect()}
    finally:
        jaccard.GROUP_TOKENS = old
    assert {d: r.component_id for d, r in got.items()} == want
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(s) for d, s in sets.items()}


def test_jaccard_small_groups_join_their_family(make):
    """A group that can have links to a family of near copies becomes part of it, so that not every copy looks at it."""
    def group(number, reps, tokens):
        return [(t, rep, number, 7) for rep in reps for t in tokens]

    rows = group(1, range(100, 130), range(10)) + group(2, [200], range(8)) + group(3, [300], range(5))
    rows += group(4, [400], range(50, 58)) + group(5, [500], range(50, 58)) + group(6, [600], range(70, 81)) + group(7, [700], range(70, 81))
    shared = make(rows, "token long, rep long, group long, least long")
    got = jaccard._alike(shared, shared.select("rep", "group").distinct())
    assert sorted(map(tuple, got.collect())) == [(1, 2), (6, 7)]


def test_jaccard_nulls_repeats_and_one_of_each(make):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(5, text, "", "", 0), (3, text, "", "", 0), (3, text, "", "", 0), (None, text, "", "", 0), (None, "other text", "", "", 0),
            (7, None, "", "", 0), (8, None, "", "", 0)]
    df = make(rows, DOCS)
    got = sorted((repr(r.doc_id), repr(r.component_id)) for r in jaccard.jaccard_components(df).collect())
    assert got == sorted([("5", "3"), ("3", "3"), ("3", "3"), ("None", "3"), ("None", "None"), ("7", "7"), ("8", "8")])
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == {3: 1, 7: 1, 8: 1, None: 2}
    assert jaccard.jaccard_components(make([], DOCS)).collect() == []


def test_components_end_with_the_last_change(spark, monkeypatch):
    from ledgerloom.llm import components

    files, keep = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: files.append(name) or keep(df, name))

    def found(links):
        files.clear()
        return {r.node: r.component for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}

    assert found([(5, 1), (1, 7), (9, 8), (9, 8), (3, 3)]) == {1: 1, 5: 1, 7: 1, 8: 8, 9: 8} and len(files) == 1
    assert found([]) == {} and len(files) == 1
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in range(400):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert found(links) == root


def test_rans_round_trip_and_checkpoints():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 50_000), 999)
    table = rans.Table(rans.scaled(np.bincount(ids, minlength=1000)))
    block = rans.Block(raw := rans.encode(ids, [4, None], np.array([49_000, 1000]), table, lanes=16))
    assert (block.ids(table) == ids).all() and block.docs == [4, None] and len(block.places) > 5
    part = block.part(3, table)  # from a checkpoint, without what is before
    assert (part == ids[3 * rans.CHECK_STEPS * 16:][:len(part)]).all()
    with pytest.raises(ValueError):
        rans.Block(raw[:-1] + bytes([raw[-1] ^ 1]))
    assert len(rans.Block(rans.encode(np.empty(0, np.int64), [], np.array([]), table)).ids(table)) == 0


def test_token_units_match_the_tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    units = tokenfile.Units(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'", "1", "é", "!", "\t", "\r\n", "日本", " ", " ", "<|endoftext|>", "\x1c", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(800)] + ["", None, "\n\n", " a\n\n"]
    ids, count = tokenfile.ids_of(Texts(pa.array(texts)), units, 2)
    cut = np.concatenate([[0], np.cumsum(count)])
    for i, t in enumerate(texts):
        assert ids[cut[i]:cut[i + 1]].tolist() == units.tokenizer.encode(t or "", add_special_tokens=False).ids + [2], repr(t)


def test_token_files(spark, make):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = odd_rows()
    got = tokenfile.encode_documents(make(rows, DOCS), path).orderBy("start").collect()
    ids = sorted(((d is not None, d or 0), tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, *_ in rows)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [d for d, _ in ids]
    assert [r.start for r in got] == [sum(len(x) for _, x in ids[:i]) for i in range(len(ids))]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (d[1] if d[0] else None, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for d, x in ids)
    assert tokenfile.encode_documents(make([], DOCS), path).collect() == []


def test_restoring_disguised_words():
    words = ["idiot", "stupid", "trash", "loser", "the", "other", "and", "rest", "list", "odd"] * 20
    counts = Counter(g for w in words for g in trigrams(w))
    model = CharModel(counts)
    for shown, meant in (("1d10t", "idiot"), ("stuuupid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("tr@sh", "trash"), ("l0s3r", "loser"),
                         ("idiot", "idiot")):
        assert restore(shown, model) == meant
    texts = Texts(pa.array(["plain words only", "an 1d10t here", "s t u p i d", None, "x" * 9 + " a b", "call 555-1234 now!!"]))
    assert disguised(texts) == [(1, b"1d10t"), (4, b"x" * 9), (2, b"stupid")]


def test_all_forms_of_disguise(spark, make):
    """Toxic words with one separator, doubled letters or set apart in pieces are found; their clean counterparts are not."""
    rng = random.Random(6)
    plain = ["well", "known", "good", "book", "the", "and", "rest", "list", "a", "b", "to", "see", "all", "is", "it", "as", "part",
             "of", "long", "term", "still", "open", "door", "small", "town", "letter", "plan"]
    bad = ["idiot", "stupid", "moron", "scum"]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    model = toxicity.learn(make(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    shown = ["id-iot", "stu.pid", "st..upid", "st.up.id", "stu pid", "st up id", "stuupid", "mor on", "mo_ron", "s c u m", "s cu m", "id iot",
             "scuum", "st-up1d"]
    docs = [f"the small town {x} and the long list {x} to see" for x in shown]
    clean = [f"the small town {x} and the long list {x} to see" for x in (
        "well-known", "a b", "good book", "all is well", "long-term", "as is", "to see it", "still open", "a.b", "it is a list")]
    got = model.score(Texts(pa.array(docs + clean)))
    assert [x for x, g in zip(shown, got) if g < 0.5] == [] and (got[len(docs):] < 0.5).all()


def test_toxicity(spark, make):
    rng = random.Random(4)
    plain = [f"{a}{b}" for a in ("than", "ers", "ing", "ous", "ent") for b in ("re", "on", "al", "st", "er")]
    bad = ["idiot", "stupid", "trash", "scum"]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w = rng.choice(bad)
                if i % 20 == 0:
                    w = w.replace("i", "1").replace("a", "@").replace("s", "5")
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None, None, None, None), (5001, "", "", "", 0), (None, "idiot stupid trash idiot", "", "", 0), (5002, "y" * 200_000, "", "", 0)]
    docs, marks = make(rows, DOCS), spark.createDataFrame(labels + [(None, None, None), (5000, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {d: t for d, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held) > 100
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and by[5000].predicted == by[5001].predicted == by[5002].predicted == 0
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)
    none = toxicity.score_documents(docs.limit(5), marks.limit(0)).collect()
    assert [r.score for r in none] == [0.0] * 5
    assert toxicity.score_documents(make([], DOCS), marks).collect() == []


def test_long_regular_words_have_their_own_ids():
    """Thue-Morse words and their complements in one batch: ids are the tokenizer's."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    one, other, texts = "a", "b", []
    for _ in range(13):
        one, other = one + other, other + one
        if len(one) >= 1024:
            texts += [one, other, f"x {one} {other}"]
    units = tokenfile.Units(path)
    ids, count = tokenfile.ids_of(Texts(pa.array(texts)), units, 2)
    cut = np.concatenate([[0], np.cumsum(count)])
    for i, text in enumerate(texts):
        assert ids[cut[i]:cut[i + 1] - 1].tolist() == units.tokenizer.encode(text, add_special_tokens=False).ids


def test_toxicity_learns_from_all_labelled_rows(spark, make):
    """A toxic word that only the labelled rows with the largest hashes have is learned among more than 20,000."""
    order = [r[0] for r in spark.range(26_000).filter("crc32(cast(cast(id AS string) AS binary)) % 5 <> 0").selectExpr(
        "id", "xxhash64(id, 8) AS h").orderBy("h").collect()]
    rare = set(order[-200:])
    assert len(order) > 20_200
    plain = ["the", "small", "town", "has", "open", "doors", "and", "long", "plans", "for", "rest"]
    rows = [(i, " ".join([plain[i % 11], plain[i % 7], "scumbag" if i in rare else plain[i % 5]]), "en", "s", 1) for i in order]
    labels = [(i, 1, int(i in rare)) for i in order]
    model = toxicity.learn(make(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = model.score(Texts(pa.array(["the small scumbag town", "the small open town"])))
    assert got[0] >= 0.5 > got[1]


def test_texts_without_a_label_stay_out_of_the_shuffle(spark, monkeypatch):
    """The filter before the join of texts and labels loses no labelled row and lets few others pass, whatever its bound."""
    docs = spark.range(-5000, 15000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    docs = docs.union(docs.limit(3)).union(spark.sql("SELECT cast(NULL AS bigint), 'none'"))
    rows = spark.range(0, 15000, 3).selectExpr("cast(id AS int) AS doc_id", "id % 2 = 0 AS toxic")
    for bound, most in ((1 << 27, 2500), (1, 20003)):
        monkeypatch.setattr(toxicity, "MOST_MARKS", bound)
        passed = toxicity.labelled_only(docs, rows)
        kept = {r.doc_id for r in passed.collect()}
        assert kept >= set(range(0, 15000, 3)) and len(kept) <= 5000 + most
    assert toxicity.labelled_only(docs, rows.limit(0)).count() == 0


def test_segments_are_built_in_pieces(monkeypatch):
    """Bits of a segment don't depend on how many keys are set at once; counts of keys add up."""
    rng = np.random.default_rng(3)
    keys, counts = rng.integers(1, 1 << 62, 5000).astype(np.uint64), rng.integers(1, 1000, 5000)
    whole = lmscore.build_bits(keys, counts)
    monkeypatch.setattr(lmscore, "BUILD_KEYS", 777)
    assert lmscore.build_bits(keys, counts) == whole
    unique, total = lmscore.merged_counts([keys, keys[:10]], [counts.astype(np.uint32), counts[:10].astype(np.uint32)])
    want = dict(zip(keys.tolist(), counts.tolist()))
    assert all(n == want[k] * (2 if k in set(keys[:10].tolist()) else 1) for k, n in zip(unique.tolist(), total.tolist())) and len(unique) == len(want)


def test_a_worker_keeps_what_one_operator_cached():
    from ledgerloom.llm import arrays
    gone = []
    arrays.keep_only("a", lambda: gone.append("a"))
    arrays.keep_only("a", lambda: gone.append("a"))
    assert gone == []
    arrays.keep_only("b", lambda: gone.append("b"))
    assert gone == ["a"]
    arrays._kept.clear()
