"""Cross-tokenizer alignment against a plain version that walks each text's tokens, and its edge cases."""

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import alignment
from ledgerloom.llm.arrays import Texts
from ledgerloom.llm.shared import stored

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def by_hand(texts):
    """The digest columns of all texts, token by token, from the tokenizers' own output."""
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letter = {}
    for byte in range(256):  # the alphabet by encoding: printable ones are themselves
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            letter[chr(byte)] = byte
    for byte in range(256):
        if byte not in letter.values():
            letter[chr(256 + len([x for x in letter if ord(x) > 255]))] = byte

    def tokens(text):
        if not text:
            return [], []
        ours = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        theirs = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
        raw = (" " + text).encode()
        return (ours, theirs) if b"".join(x for _, x in ours) == raw == b"".join(x for _, x in theirs) else ([], [])

    def ends(side):
        out, at = [], 0
        for _, x in side:
            at += len(x)
            out.append(at)
        return out

    rows, counts = [], Counter()
    for text in texts:
        ours, theirs = tokens(text)
        end_a, end_b = ends(ours), ends(theirs)
        cuts = sorted(set(end_a) & set(end_b))
        groups, i, j = [], 0, 0
        for cut in cuts:
            m, k = i, j
            while i < len(ours) and end_a[i] <= cut:
                i += 1
            while j < len(theirs) and end_b[j] <= cut:
                j += 1
            groups.append((ours[m:i], theirs[k:j]))
        links, i, j = [], 0, 0
        while i < len(ours) and j < len(theirs):
            links.append((ours[i][0], theirs[j][0]))
            step = min(end_a[i], end_b[j])
            i, j = i + (end_a[i] == step), j + (end_b[j] == step)
        counts.update(links)
        rows.append((ours, theirs, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for ours, theirs, groups, links in rows:
        text = ";".join(",".join(str(i) for i, _ in g) + "|" + ",".join(str(i) for i, _ in h) for g, h in groups)
        out.append((len(ours), len(theirs), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if ours else ""))
    return out


def digest(row):
    return (row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum, row.groups_sha256)


ODD = ["", None, " ", "  ", "a", " a", "a  b", "a \n\n  b\t\tc ", "x\r\ny;\r", "\n", "\t\tx", "a  b", "a 　  b c", "\x1c x",
       "a▁b", "<|endoftext|> <s></s> <unk> <0x0A>", "thé Ñandú ÜBER 😀👍🏽 ﷽ ​ ﻿", "it's we'LL don't 12345 1,000.50 !!!???",
       "\x00\x01 \x7f", "́ é", "aaaaaaaaaa " * 50, "z" * 5000, "word " * 3000, "日本語のテキスト と 漢字", "a\x0b\x0cb\x0c c"]


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 50])
def test_alignment_by_hand(spark, make, heavy):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ODD[3:12]
    ids = [None if i in (5, 6) else i % 80 for i in range(len(texts))]
    docs = make([(i, t, "en", "s", 1) for i, t in zip(ids, texts)], DOCS)
    got = alignment.align_documents(docs, A, B, heavy).collect()
    want = by_hand(texts)
    assert sorted((repr(r.doc_id), digest(r)) for r in got) == sorted((repr(i), w) for i, w in zip(ids, want))


def test_vectors_hold_exact_links_and_pairs_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    links = stored(alignment.align(docs, A, B), "links")
    pair = alignment._pair(A, B)
    same = [i for i, b in enumerate(pair.identity) if b >= 0]
    assert all(pair.of_a.tokens[i] == pair.of_b.tokens[pair.identity[i]] for i in same) and len(same) > 10_000
    counts = alignment.pair_counts(links, A, B)
    row = counts.agg(F.sum("n").alias("n"), F.countDistinct("key").alias("keys"), F.count("*").alias("rows")).first()
    assert row.keys == row.rows and row.n == links.agg(F.sum("n_links")).first()[0]
    exact = links.select(F.sum(F.length("exact"))).first()[0]
    assert exact and exact < 4 * row.n


def test_cache_starts_anew(spark):
    pair = alignment.Pair(A, B)
    texts = Texts(alignment._prefixed(pa.array(["one two  three", "two one"])))
    import numpy as np
    none = np.zeros(2, dtype=bool)
    first = [pair.text[i] for i in pair.units_of(texts, none)[0]]
    old, alignment.CACHE_BYTES = alignment.CACHE_BYTES, 0
    try:
        again = [pair.text[i] for i in pair.units_of(texts, none)[0]]
    finally:
        alignment.CACHE_BYTES = old
    assert first == again and len(pair.text) == 3


def test_alignment_without_rows(spark, make):
    assert alignment.align_documents(make([], DOCS), A, B).collect() == []
    got = alignment.align_documents(make([(1, None, None, None, None), (1, "", "en", "s", 0)], DOCS), A, B).collect()
    assert [digest(r) for r in got] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_long_regular_spans_hash_apart():
    """Thue-Morse words and their complements, which a polynomial modulo 2^64 can't tell apart."""
    for power in range(5, 14):
        one, other = "a", "b"
        for _ in range(power):
            one, other = one + other, other + one
        texts = Texts(pa.array([one, other, one]))
        got = texts.hashes(texts.offsets[:-1], texts.offsets[1:])
        assert got[0] != got[1] and got[0] == got[2]
