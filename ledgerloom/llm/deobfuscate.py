"""Noisy-channel deobfuscation of single words.

A disguised word is a lattice: each character stands for itself, for the letters it looks like, for nothing (a separator
between letters), or, as a repeated letter, for one or two of it. The Viterbi path under a character trigram model is the
restored word. Words that show a disguise are decoded; the same word is decoded once for each worker and model. Where the
plain reading may be meant (one separator, a doubled letter, pieces set apart), the model decides between the two.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa

from ledgerloom.llm.arrays import IS_WORD, Texts

# Letters that digits and signs are used for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
         "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = ".-_*~'^/,"
SWAP, DROP, ONCE = 1.0, 0.5, 0.3  # costs (negative logarithms) of the channel
EDGE, OTHER = "\x02", "\x01"
LONGEST = 40  # bytes of a word that is read as one; parts of longer ones, as of web addresses, are looked at by ``pieces``
_SPLIT = f"[{re.escape(SEPARATORS)}]+"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGN = np.zeros(256, dtype=bool)  # stand for a letter beside a letter
_SIGN[[ord(c) for c in "0123456789@$"]] = True
_INNER = _SIGN.copy()  # stand for a letter before a letter
_INNER[[ord(c) for c in "!|+("]] = True
_CUT = np.zeros(256, dtype=bool)
_CUT[[ord(c) for c in SEPARATORS]] = True


class CharModel:
    """Character trigrams of lower-case words; all letters but a-z count as one."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.context: dict[str, int] = {}
        self.costs: dict[str, float] = {}  # three of 28 signs: bounded
        for gram, n in counts.items():
            self.context[gram[:2]] = self.context.get(gram[:2], 0) + n

    def cost(self, before: str, char: str) -> float:
        found = self.costs.get(before + char)
        if found is None:
            found = self.costs[before + char] = -math.log(
                (self.counts.get(before + char, 0) + 0.05) / (self.context.get(before, 0) + 0.05 * 28))
        return found


def plain(char: str) -> str:
    return char if "a" <= char <= "z" else OTHER


def trigrams(word: str) -> list[str]:
    padded = EDGE * 2 + "".join(plain(c) for c in word) + EDGE
    return [padded[i:i + 3] for i in range(len(padded) - 2)]


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each place of a word, what it may stand for and at which cost."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(word):
        c = word[i]
        j = i + 1
        while j < len(word) and word[j] == c:
            j += 1
        if c.isalpha():
            single = [(c, 0.0 if j - i == 1 else ONCE)]
            out.append(single + ([(c * 2, 0.0 if j - i == 2 else ONCE)] if j - i > 1 else []))
            i = j
            continue
        letters = [(x, SWAP) for x in LOOKS.get(c, "")]
        if c in SEPARATORS or not letters:
            letters.append(("", DROP))
        if len(letters) and c in LOOKS and j - i > 1:  # a run of one sign is one letter, or two
            out.append([(x, s + ONCE) for x, s in letters] + [(x * 2, s + ONCE) for x, s in letters if x])
            i = j
            continue
        out.append(letters)
        i += 1
    return out


def decode(word: str, model: CharModel) -> tuple[float, str]:
    """The letters that a disguised word most likely stands for, and the cost of this reading."""
    best: dict[str, tuple[float, tuple]] = {EDGE * 2: (0.0, ())}
    for options in lattice(word.lower()):
        now: dict[str, tuple[float, tuple]] = {}
        for state, (cost, path) in best.items():
            for text, extra in options:
                s, total = state, cost + extra
                for c in text:
                    total += model.cost(s, plain(c))
                    s = s[1] + plain(c)
                if s not in now or total < now[s][0]:
                    now[s] = (total, (path, text) if text else path)
        best = now
    cost, path = min((c + model.cost(s, EDGE), p) for s, (c, p) in best.items())
    out = []
    while path:
        path, text = path
        out.append(text)
    return cost, "".join(reversed(out))


def restore(word: str, model: CharModel) -> str:
    """The letters that a disguised word most likely stands for."""
    return decode(word, model)[1]


def one_word(pieces: tuple[str, ...], model: CharModel) -> bool:
    """Whether pieces set apart are more likely one word than a word each."""
    whole = decode("".join(pieces), model)[0] + DROP * (len(pieces) - 1)
    return whole < sum(decode(p, model)[0] for p in pieces)


def reading(word: str, model: CharModel) -> str:
    """The restored form of a word that may be disguised; empty if the plain reading is as likely."""
    cost, text = decode(word, model)
    pieces = [p for p in re.split(_SPLIT, word) if p]
    plain_cost = math.inf if len(pieces) < 2 else sum(decode(p, model)[0] for p in pieces)
    return text if cost < plain_cost and text != word.lower() else ""


def disguised(texts: Texts) -> list[tuple[int, bytes]]:
    """(text, word) for the words that show a disguise; letters set apart by blanks are put together."""
    data, size = texts.data, len(texts.data)
    starts, ends, first = texts.words(IS_WORD)
    if not len(starts):
        return []
    letter = _LETTER[data]
    show = np.zeros(size + 1, dtype=np.int64)
    show[1:size] += _INNER[data[:-1]] & letter[1:]
    show[1:size] += letter[:-1] & _SIGN[data[1:]]
    if size > 2:
        show[1:size - 1] += (data[:-2] == data[1:-1]) & (data[1:-1] == data[2:]) & letter[1:-1] & (data[1:-1] < 128)
    if size > 4:  # x.y.z
        cut = _CUT[data]
        show[1:size - 3] += letter[:-4] & cut[1:-3] & letter[2:-2] & cut[3:-1] & letter[4:]
    total = np.cumsum(show)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    some = np.flatnonzero(total[ends - 1] > total[starts])
    raw = data.tobytes()
    out = [(int(doc[i]), raw[starts[i]:ends[i]]) for i in some]
    alone = (ends - starts == 1) & (letter[starts] | _SIGN[data[starts]] | _INNER[data[starts]])
    begins = np.flatnonzero(alone & ~np.concatenate([[False], alone[:-1] & (doc[:-1] == doc[1:])]))
    stops = np.flatnonzero(alone & ~np.concatenate([alone[1:] & (doc[:-1] == doc[1:]), [False]]))
    for a, b in zip(begins, stops):
        if b - a >= 3:
            out.append((int(doc[a]), bytes(data[starts[a:b + 1]])))
    return out


def doubtful(texts: Texts) -> list[tuple[int, bytes]]:
    """(text, word) for the words that may be disguised: with a separator inside, or a doubled letter."""
    data, size = texts.data, len(texts.data)
    starts, ends, first = texts.words(IS_WORD)
    if size < 3 or not len(starts):
        return []
    letter, cut = _LETTER[data] | _SIGN[data] | _INNER[data], _CUT[data]
    twice = np.zeros(size + 1, dtype=np.int64)
    twice[2:] = np.cumsum((data[:-1] == data[1:]) & _LETTER[data[1:]] & (data[1:] < 128))
    begins = np.concatenate([[0], np.cumsum(letter[:-1] & cut[1:]), [0]])  # a letter, then a separator
    stops = np.concatenate([[0], np.cumsum(cut[:-1] & letter[1:]), [0]])
    last = np.maximum(ends - 1, starts)
    some = (twice[ends] > twice[starts + 1]) | ((begins[last] > begins[starts]) & (stops[last] > stops[starts]))
    some = np.flatnonzero(some & (ends - starts <= LONGEST))
    doc = np.searchsorted(first, some, side="right") - 1
    raw = data.tobytes()
    return [(int(d), raw[starts[i]:ends[i]]) for d, i in zip(doc, some)]


def pieces(texts: Texts, of: np.ndarray, longest: int = 24):
    """Runs of two and more words (of the bytes ``of``) with only blanks and separators between them.

    Gives for each number of words: the texts without all other bytes, the spans of the runs in them, the numbers of their
    first words, the lengths of these, and the starts and ends of all words in the given texts.
    """
    starts, ends, first = texts.words(of)
    gap = ~(_CUT[texts.data] | np.isin(texts.data, [0x20, 0x09]))
    other = np.concatenate([[0], np.cumsum(gap)])
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    after = np.zeros(len(starts), dtype=bool)  # goes on in the next word
    after[:-1] = (doc[1:] == doc[:-1]) & (other[starts[1:]] == other[ends[:-1]])
    size = ends - starts
    stop = np.cumsum(size)
    begin = stop - size
    joined = Texts(pa.array([texts.data[of[texts.data]].tobytes()], pa.large_binary()))
    at, k = np.arange(len(starts)), 1
    while True:
        at = at[after[at + k - 1]]
        at = at[stop[at + k] - begin[at] <= longest]
        if not len(at):
            return
        yield joined, begin[at], stop[at + k], at, k + 1, size[at], doc[at], (starts, ends)
        k += 1
