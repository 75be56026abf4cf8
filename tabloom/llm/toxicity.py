"""Toxicity by a string-kernel support vector machine (operator 1).

The kernel is the gap-weighted subsequence kernel of order three: a common subsequence of three symbols counts DECAY to
the power of the stretch that it spans, in both strings, up to a stretch of SPAN, so inserted characters weaken a match
but do not end it. The strings are the windows of a text's sentences: every word, and every two neighbouring words with
the blank between them, so subsequences run across blanks ("wor thless") and an insult may be two words that are each
harmless alone. Case, accents and punctuation inside words are folded away, and four or more spaced-out single letters
are read as one word. A sentence scores as its worst window and a text as its worst sentence.

Training is multiple-instance learning on labelled texts: the windows of clean sentences are negative; of the toxic
ones, the first witnesses are the windows whose share of toxic texts chance does not explain, and each round the
machine picks every toxic text's own worst window as a further witness, and the worst windows of clean texts as
further negatives.

Nystroem: landmark windows from the labelled sample span the feature space, and a squared-hinge machine is trained there.
Because a subsequence kernel is an inner product over the 64 ** 3 possible triples, the trained machine (landmark
weights through the inverse root of the landmark kernel) folds into one weight per triple, exactly: a text costs 21 table
look-ups per character, whatever the number of landmarks or of distinct words, and all windows follow from prefix sums.

The model is a table of 64 ** 3 floats and a few numbers, the same size for any input.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, identifier, mix, powers

ORDER, DECAY, SYMBOLS = 3, 0.6, 64
#: Most symbols that a subsequence spans; symbols of one piece of a word (longer ones are cut); symbol of a blank.
SPAN, PIECE, BLANK = 8, 24, 63
#: Bounds of the fit, all parameters of train(): labelled documents (chosen by a hash of id and text), windows that open
#: as witnesses, negatives by frequency and by chance, further negatives a round, landmarks of each kind.
TRAIN_DOCS, WITNESSES, NEGATIVES, HARD, LANDMARKS = 4000, 400, 4000, 1000, 128
#: Characters that are scored at once; bounds a worker's memory.
CHUNK_CHARS = 1 << 16
_SPACE, _MARK, _LETTER, _DIGIT, _STOP, _BREAK = range(6)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and symbol of each code point of the basic plane."""
    kind, symbol = np.full(65536, _MARK, np.uint8), (np.arange(65536) % 27 + 36).astype(np.uint8)
    for k in range(65536):
        c = chr(k)
        if c in "\n\r\v\f\x85  ":
            kind[k] = _BREAK
        elif c.isspace():
            kind[k] = _SPACE
        elif c.isalpha():
            kind[k] = _LETTER
            base = unicodedata.normalize("NFD", c)[0]
            if "a" <= base <= "z":
                symbol[k] = ord(base) - 97
        elif c.isdigit():
            kind[k], symbol[k] = _DIGIT, 26 + k % 10
    symbol[48:58] = np.arange(26, 36)
    kind[[ord(c) for c in ".!?;。"]] = _STOP
    return kind, symbol


_KIND, _SYMBOL = _tables()
#: Norm of a string of n symbols: the root of the squared weights of its subsequences, each place on its own.
_NORM = np.sqrt(np.cumsum([0.0, *(sum((k - 1) * DECAY ** (2 * k + 2) for k in range(2, min(SPAN, n))) for n in range(1, 2 * PIECE + 2))])).astype(np.float32)
_SCALE = np.where(_NORM > 0, 1 / np.where(_NORM > 0, _NORM, 1), 0).astype(np.float32)
_values = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)


class Reading:
    """The words of several texts laid end to end, as symbols with a blank after each word.

    start, end: symbol bounds of each word; end2: end of the next word of the same sentence, or its own; text: index of
    the word's text.
    """

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        raw = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = np.where(raw > 65535, 0x4E00 + raw % 27, raw)
        kind = _KIND[raw]
        blank = (kind == _SPACE) | (kind == _BREAK)
        ends = np.append(blank[1:], True)
        sentence = np.cumsum((kind == _BREAK) | ((kind == _STOP) & ends))
        at = np.flatnonzero((kind == _LETTER) | (kind == _DIGIT))
        n = len(at)
        if not n:
            self.symbols, self.start, self.end, self.end2, self.text = (np.zeros(0, np.int64),) * 5
            return
        bounds = np.cumsum([len(t) + 1 for t in lowered])
        word, sentence = np.cumsum(blank)[at], sentence[at]
        begin = np.append(True, word[1:] != word[:-1])
        starts = np.flatnonzero(begin)
        sizes = np.diff(np.append(starts, n))
        # runs of single letters of one sentence are one word
        single = (sizes == 1) & (kind[at[starts]] == _LETTER)
        same = np.append(False, sentence[starts][1:] == sentence[starts][:-1])
        follows = single & np.append(False, single[:-1]) & same
        run = np.cumsum(~follows)
        begin[starts[follows & (np.bincount(run)[run] >= 4)]] = False
        starts = np.flatnonzero(begin)
        inside = np.arange(n) - starts[np.cumsum(begin) - 1]
        starts = np.flatnonzero(inside % PIECE == 0)
        index = np.cumsum(inside % PIECE == 0) - 1
        count = np.arange(len(starts))
        self.symbols = np.full(n + len(starts), BLANK, np.uint8)
        self.symbols[np.arange(n) + index] = _SYMBOL[raw[at]]
        self.start, self.end = starts + count, np.append(starts[1:], n) + count
        last = np.append(sentence[starts][1:] != sentence[starts][:-1], True)
        self.end2 = np.where(last, self.end, np.append(self.end[1:], 0))
        self.text = np.searchsorted(bounds, at[starts], "right")

    def windows(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum over each word's, and each word pair's, subsequences of decay times weight, over the string's norm."""
        n = len(self.symbols)
        code = np.append(self.symbols, np.full(SPAN, BLANK)).astype(np.int32)
        left = np.diff(np.append(self.start, n))  # symbols of a word and its blank
        one, two = np.repeat(self.end, left) - np.arange(n), np.repeat(self.end2, left) - np.arange(n)
        heads = [code[:n] * (SYMBOLS * SYMBOLS) + code[j : n + j] * SYMBOLS for j in range(1, SPAN - 1)]
        inner, both = np.zeros(n, np.float32), np.zeros(n, np.float32)
        for k in range(2, SPAN):
            tail = code[k : n + k]
            part = weights.take(heads[0] + tail)
            for j in range(1, k - 1):
                part += weights.take(heads[j] + tail)
            part *= np.float32(DECAY ** (k + 1))
            inner += part * (one > k)
            both += part * (two > k)
        inner, both = np.append(0.0, np.cumsum(inner, dtype=np.float64)), np.append(0.0, np.cumsum(both, dtype=np.float64))
        own = inner[self.end] - inner[self.start]
        pair = both[np.append(self.start[1:], n)] - both[self.start] + np.append(own[1:], 0.0)
        paired = self.end2 > self.end
        return own * _SCALE[self.end - self.start], np.where(paired, pair * _SCALE[self.end2 - self.start], -np.inf)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of each word and of each word pair."""
        power, inverse = powers(_BASE, len(self.symbols) + 1)
        total = np.zeros(len(self.symbols) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_values[self.symbols] * power[: len(self.symbols)], out=total[1:])
            return tuple(mix((total[end] - total[self.start]) * inverse[self.start] + (end - self.start).astype(np.uint64)) for end in (self.end, self.end2))

    def string(self, word: int, pair: bool) -> bytes:
        return self.symbols[self.start[word] : (self.end2 if pair else self.end)[word]].astype(np.uint8).tobytes()


def string_of(text: str) -> bytes:
    """The symbols of a text read as one string, blanks between its words."""
    return Reading([text]).symbols[:-1].astype(np.uint8).tobytes()


_layouts: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _layout(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of n symbols, and their weights scaled to norm one."""
    if n not in _layouts:
        at = np.array([(i, i + j, i + k) for i in range(n) for k in range(2, min(SPAN, n - i)) for j in range(1, k)], np.int64).reshape(-1, ORDER)
        _layouts[n] = at, (DECAY ** (at[:, -1] - at[:, 0] + 1) * _SCALE[n]).astype(np.float32)
    return _layouts[n]


def features(strings: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indexes of strings, triple codes, weights), by length; shorter than ORDER: left out."""
    by_length: dict[int, list[int]] = {}
    for k, s in enumerate(strings):
        by_length.setdefault(len(s), []).append(k)
    for n, own in by_length.items():
        if n >= ORDER:
            at, weights = _layout(n)
            symbols = np.frombuffer(b"".join(strings[k] for k in own), np.uint8).reshape(len(own), n).astype(np.int32)
            a, b, c = (symbols[:, at[:, k]] for k in range(ORDER))
            yield np.array(own), (a * SYMBOLS + b) * SYMBOLS + c, weights


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    cut: float

    def decide(self, strings: list[bytes]) -> np.ndarray:
        """The machine's decision for each string; one too short for the kernel gets the bias."""
        out = np.full(len(strings), self.bias)
        for own, codes, value in features(strings):
            out[own] += self.weights[codes] @ value
        return out

    def worst(self, texts: list[str]) -> np.ndarray:
        """The largest decision of each text's windows; a text without words gets the bias."""
        out = np.full(len(texts), -np.inf)
        for a, b in chunks([len(t) for t in texts]):
            reading = Reading(texts[a:b])
            if len(reading.start):
                np.maximum.at(out, a + reading.text, np.maximum(*reading.windows(self.weights)))
        return np.where(np.isfinite(out), out, 0.0) + self.bias

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (decision - self.cut), -30, 30)))


def chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Slices of about CHUNK_CHARS; a longer text makes one of its own, whole."""
    at = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > CHUNK_CHARS:
            yield at, k
            at, total = k, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


class Landmarks:
    """Feature vectors of the landmark strings, over the triples that occur in any of them."""

    def __init__(self, strings: list[bytes]):
        found = list(features(strings))
        self.codes = np.unique(np.concatenate([codes.ravel() for _, codes, _ in found]))
        self.column = np.zeros(SYMBOLS**ORDER, np.int32)  # 0: in no landmark
        self.column[self.codes] = np.arange(1, len(self.codes) + 1)
        self.table = np.zeros((len(self.codes) + 1, len(strings)), np.float32)
        for own, codes, value in found:
            np.add.at(self.table, (self.column[codes], own[:, None]), value)

    def kernel(self, strings: list[bytes]) -> np.ndarray:
        """Kernel between strings and landmarks."""
        n = self.table.shape[1]
        out = np.zeros((len(strings), n), np.float32)
        for own, codes, value in features(strings):
            step = max(1, 2_000_000 // (codes.shape[1] * n))
            for at in range(0, len(own), step):
                out[own[at : at + step]] = np.einsum("ncl,c->nl", self.table[self.column[codes[at : at + step]]], value)
        return out

    def fold(self, weights: np.ndarray) -> np.ndarray:
        """One weight per triple from one per landmark."""
        out = np.zeros(SYMBOLS**ORDER, np.float32)
        out[self.codes] = self.table[1:] @ weights
        return out


def _squared_hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Primal Newton steps; the last column of z is the constant."""
    w = np.zeros(z.shape[1])

    def loss(w: np.ndarray) -> float:
        return float((cost * np.maximum(0, 1 - y * (z @ w)) ** 2).sum() + ridge * w @ w)

    now = loss(w)
    for _ in range(60):
        active = y * (z @ w) < 1
        za, ca = z[active], cost[active]
        step = np.linalg.solve((za * ca[:, None]).T @ za + ridge * np.eye(z.shape[1]), za.T @ (ca * y[active])) - w
        size = 1.0
        while (then := loss(w + size * step)) > now and size > 1e-4:
            size /= 2
        if now - then < 1e-7 * now:
            break
        w, now = w + size * step, then
    return w


def _gapped(s: bytes) -> list[bytes]:
    """The string with a foreign symbol, a blank and a doubled symbol inside, at places that its hash picks."""
    seed = int(np.frombuffer(s.ljust(8, b"\0")[:8], np.uint64)[0]) * 0x9E3779B97F4A7C15 >> 20
    at, then, last = (1 + (seed >> b) % max(1, len(s) - 1) for b in (0, 7, 14))
    out = [s[:at] + bytes([b"\x17\x10\x19\x0a\x09\x15\x16"[seed % 7]]) + s[at:], s[:then] + bytes([BLANK]) + s[then:], s[:last] + s[last - 1 : last] + s[last:]]
    return [x[: 2 * PIECE + 1] for x in out]


class Windows:
    """Distinct windows of the sample's texts: in how many texts of each label, where one stands, in which texts."""

    def __init__(self, texts: list[str]):
        slices = list(chunks([len(t) for t in texts]))
        self.readings = [Reading(texts[a:b]) for a, b in slices]
        columns: tuple[list[np.ndarray], ...] = ([], [], [], [], [])
        for r, (reading, (first, _)) in enumerate(zip(self.readings, slices)):
            words, pairs = reading.hashes()
            paired = np.flatnonzero(reading.end2 > reading.end)
            every = np.arange(len(words))
            for hashes, own, pair in ((words, every, 0), (pairs[paired], paired, 1)):
                for c, x in zip(columns, (hashes, (first + reading.text[own]).astype(np.int32), np.full(len(own), r, np.int32), own.astype(np.int32), np.full(len(own), pair, np.int8))):
                    c.append(x)
            reading.start, reading.end, reading.end2 = (x.astype(np.int32) for x in (reading.start, reading.end, reading.end2))
            reading.text = None  # the windows know it
        joined = []
        for c in columns:  # one after the other, so that they are not in memory twice
            joined.append(np.concatenate(c))
            c.clear()
        hashes, text, self.r, self.word, self.pair = joined
        del joined, words, pairs
        order = np.lexsort((text, hashes)).astype(np.int32)
        hashes, text = hashes[order], text[order]
        new = np.append(True, hashes[1:] != hashes[:-1])
        self.of_text = new | np.append(True, text[1:] != text[:-1])
        self.group = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.text, self.order, self.keys = text, order, hashes[new]
        self.example = order[new]
        self.n = len(self.keys)
        self.size = np.zeros(self.n, np.int32)
        by = np.argsort(self.r[self.example], kind="stable").astype(np.int32)  # narrow arrays: these stay for the whole fit
        cuts = np.searchsorted(self.r[self.example][by], np.arange(len(self.readings) + 1))
        self.by_reading = [by[a:b] for a, b in zip(cuts, cuts[1:])]
        for own, reading in zip(self.by_reading, self.readings):
            w = self.word[self.example[own]]
            self.size[own] = np.where(self.pair[self.example[own]] == 1, reading.end2[w], reading.end[w]) - reading.start[w]

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """Of the texts that are chosen, how many hold each window."""
        return np.bincount(self.group[self.of_text], chosen[self.text[self.of_text]].astype(float), self.n)

    def string(self, k: int) -> bytes:
        e = self.example[k]
        return self.readings[self.r[e]].string(self.word[e], self.pair[e] == 1)

    def strings(self, ks: np.ndarray) -> list[bytes]:
        return [self.string(k) for k in ks.tolist()]

    def decisions(self, model: Model) -> np.ndarray:
        """The decision of each distinct window."""
        out = np.zeros(self.n)
        for own, reading in zip(self.by_reading, self.readings):
            if len(reading.start):
                both = np.stack(reading.windows(model.weights))
                out[own] = both[self.pair[self.example[own]], self.word[self.example[own]]]
        return out + model.bias

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows that are the first and the second word of each pair; those of other windows are themselves."""
        by_place = np.empty(len(self.order), np.int32)
        by_place[self.order] = self.group
        base = np.searchsorted(self.r, np.arange(len(self.readings)))  # a reading's words come before its pairs
        e = self.example
        first = by_place[base[self.r[e]] + self.word[e]]
        second = np.where(self.pair[e] == 1, by_place[np.minimum(base[self.r[e]] + self.word[e] + 1, len(by_place) - 1)], first)
        return first, second


def _first_of_copies(windows: Windows, n_texts: int, size: int = 16) -> np.ndarray:
    """Texts that share less than half of their bottom sketch with an earlier one: counting windows over copies would
    take chance for evidence."""
    one = windows.of_text & (windows.pair[windows.order] == 0)
    text, key = windows.text[one], windows.keys[windows.group[one]]
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    cuts = np.searchsorted(text, np.arange(n_texts + 1))
    seen: dict[int, list[int]] = {}
    out = np.zeros(n_texts, bool)
    for k in range(n_texts):
        sketch = key[cuts[k] : min(cuts[k] + size, cuts[k + 1])].tolist()
        near = Counter(j for h in sketch for j in seen.get(h, ()))
        if sketch and near and max(near.values()) * 2 > len(sketch):
            continue
        out[k] = True
        for h in sketch:
            seen.setdefault(h, []).append(k)
    return out


def _worst_windows(decision: np.ndarray, group: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The first window of the largest decision of each text; group: the windows of texts that begin at begin."""
    own = decision[group]
    hit = np.flatnonzero(own == np.repeat(np.maximum.reduceat(own, begin), np.diff(np.append(begin, len(own)))))
    return group[hit[np.searchsorted(hit, begin)]]


def _evidence(a: np.ndarray, b: np.ndarray, base: float) -> np.ndarray:
    """Twice the log likelihood ratio of a toxic and b clean texts, where these are mostly toxic ones."""
    share = a / np.maximum(1, a + b)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 2 * (a * np.log(share / base) + np.where(b > 0, b * np.log((1 - share) / (1 - base)), 0.0))
    return np.where(share > base, out, 0.0)


def fit(texts: list[str], labels: list[int], rounds: int = 2, witnesses: int = WITNESSES, negatives: int = NEGATIVES, hard: int = HARD, landmarks: int = LANDMARKS) -> Model:
    """Without both labels in the sample: a constant score, the share of label 1 (one half with no sample at all)."""
    truth = np.array(labels, bool)
    if not truth.any() or truth.all():
        share = (truth.sum() + 0.5) / (len(labels) + 1) if labels else 0.5
        return Model(np.zeros(SYMBOLS**ORDER, np.float32), float(np.log(share / (1 - share))), 1.0, 0.0)
    found = Windows(texts)
    first = _first_of_copies(found, len(texts))
    bad, good = found.counts(first & truth), found.counts(first & ~truth)
    base = max(float((first & truth).sum()), 0.5) / first.sum()
    evidence = np.where(found.size >= ORDER, _evidence(bad, good, base), 0.0)
    bad, good = bad.astype(np.int32), good.astype(np.int32)
    often = (bad >= 3) & (found.size >= ORDER)
    chance = 2 * np.log(often.sum() + 1)  # what the luckiest of so many windows reaches without meaning
    left, right = found.halves()
    found.order = None
    pair = left != right
    # a pair has to say more than its words do, and then speaks for them
    more = evidence - np.where(pair, np.maximum(evidence[left], evidence[right]), 0.0)
    strong = often & (evidence > chance) & (~pair | (more > chance))
    spoken = np.zeros(found.n, bool)
    for half in (left, right):
        spoken[half[strong & pair]] = True
    strong &= pair | ~spoken
    if not strong.any():
        strong = (bad > 0) & (found.size >= ORDER) & ~pair if not often.any() else often & ~pair
        strong &= evidence >= np.sort(evidence[strong])[-min(10, strong.sum())] if strong.any() else strong
    if not strong.any():
        share = truth.mean()
        return Model(np.zeros(SYMBOLS**ORDER, np.float32), float(np.log(share / (1 - share))), 1.0, 0.0)
    key = found.keys
    chosen = np.flatnonzero(strong)
    positive = chosen[np.lexsort((key[chosen], -evidence[chosen]))][:witnesses]
    strength = dict(zip(positive.tolist(), np.maximum(evidence[positive], 1.0).tolist()))
    clean = np.flatnonzero((good > 0) & ~strong & (found.size >= ORDER))
    common = clean[np.lexsort((key[clean], -good[clean]))][:negatives]
    by_chance = clean[np.argsort(key[clean], kind="stable")][:negatives]
    del left, right, pair, more, spoken, strong, often, evidence, chosen
    negative = dict.fromkeys(np.concatenate([common, by_chance]).tolist())
    marks = found.strings(positive[:landmarks]) + found.strings(common[:landmarks])
    space = Landmarks(marks)
    values, vectors = np.linalg.eigh((space.table.T @ space.table).astype(np.float64))
    fine = values > 1e-6
    root = vectors[:, fine] / np.sqrt(values[fine])
    cache: dict[bytes, np.ndarray] = {}

    def z_of(strings: list[bytes]) -> np.ndarray:
        new = list(dict.fromkeys(s for s in strings if s not in cache))
        cache.update(zip(new, space.kernel(new) @ root))
        return np.stack([cache[s] for s in strings])

    # every window of a text, to find the text's worst one
    by_text = np.argsort(found.text, kind="stable").astype(np.int32)  # within a text by hash
    group, ends = found.group[by_text], np.bincount(found.text, minlength=len(texts)).cumsum()
    of = np.flatnonzero(np.diff(ends, prepend=0))
    begin, until = np.append(0, ends[:-1])[of], ends[of]
    found.text = found.of_text = found.group = found.keys = by_text = key = None
    model = None
    for _ in range(rounds):
        plus, minus = found.strings(np.array(list(strength))), found.strings(np.array(list(negative)))
        z = z_of(plus + [g for s in plus for g in _gapped(s)] + minus)
        z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
        y = np.repeat([1.0, -1.0], [4 * len(plus), len(minus)])
        root_strength = np.sqrt(list(strength.values()))
        weight = np.sqrt(good[list(negative)] + 1)
        cost = np.concatenate([root_strength / root_strength.sum(), np.repeat(root_strength, 3) / 40 / root_strength.sum(), weight / weight.sum()]) * 1000
        w = _squared_hinge(z, y, cost)
        model = Model(space.fold(root @ w[:-1]), float(w[-1]), 1.0, 0.0)
        decision = found.decisions(model)
        best = np.concatenate([_worst_windows(decision, group[begin[a] : until[a : a + 256][-1]], begin[a : a + 256] - begin[a]) for a in range(0, len(begin), 256)])
        # witnesses: the worst windows of toxic texts that more toxic than clean texts hold
        mine = Counter(best[truth[of] & (decision[best] > 0)].tolist())
        for k, times in mine.items():
            if found.size[k] >= ORDER and bad[k] >= 2 and bad[k] > 2 * good[k] and k not in negative:
                strength.setdefault(k, float(times))
        worst_clean = clean[np.argsort(-decision[clean], kind="stable")][:hard]
        negative.update(dict.fromkeys(k for k in worst_clean.tolist() if k not in strength))
    witnessed = found.strings(positive[: max(1, len(positive) // 2)])
    del found, group, clean, bad, good, decision
    worst = model.worst(texts)
    model.slope, model.cut = _calibrate(worst, truth.astype(float))
    # texts hold several witnesses, so the curve through whole texts would ask for more than one; where clean texts end
    # below the witnesses, the cut goes between them, nearer to the toxic side (two in a hundred clean labels may be wrong)
    low, high = np.quantile(worst[~truth], 0.98), model.decide(witnessed).min()
    if high > low:
        model.cut, model.slope = float(low + 0.72 * (high - low)), max(model.slope, 4 / float(high - low))
    return model


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through (decision, label); its slope is positive."""
    z = np.stack([x, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(float(w[0]), 1e-3)
    return slope, -float(w[1]) / slope


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, text, toxic of at most most labelled rows that are not held out, chosen by a hash of id and text.

    About twice as many labels are broadcast, whatever the number of labels and documents.

    Rows that repeat both are one. A label other than 0 or 1 is none; of two labels of a document the larger counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, 2 * most / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    keyed = docs.join(F.broadcast(some), "doc_id").withColumn("key", F.xxhash64("doc_id", "text"))
    return keyed.dropDuplicates(["key"]).orderBy("key").limit(most).select("doc_id", "text", "toxic")


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _probabilities(model: Model, column: pa.Array, step: int = 500) -> np.ndarray:
    parts = [model.worst([t or "" for t in column.slice(at, step).to_pylist()]) for at in range(0, len(column), step)]
    return model.probability(np.concatenate(parts) if parts else np.zeros(0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a megabyte, for any input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_probabilities(shared.value, batch.column(1)))], schema=_SCORED)

    return docs.mapInArrow(run, "doc_id long, score double")


_FITTED = pa.schema([("weights", pa.binary()), ("bias", pa.float64()), ("slope", pa.float64()), ("cut", pa.float64())])


def _release() -> None:
    """What other operators keep in this worker (token ids of pieces, powers) goes: the fit needs the room, they can
    make it again."""
    tokens = sys.modules.get("tabloom.llm.tokens")
    if tokens:
        tokens._shared.clear()
    _powers.clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((i, t or "", y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns)))
    _release()
    model = fit([r[1] for r in rows], [r[2] for r in rows])
    yield pa.RecordBatch.from_pylist([{"weights": model.weights.tobytes(), "bias": model.bias, "slope": model.slope, "cut": model.cut}], schema=_FITTED)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fitted in one executor task over the bounded sample; only the model, of fixed size, comes to the driver."""
    sample = training_rows(docs, labels, train_docs).repartition(1)
    row = sample.mapInArrow(_fit_rows, "weights binary, bias double, slope double, cut double").first()
    if row is None:  # no sample at all
        return fit([], [])
    return Model(np.frombuffer(row.weights, np.float32), row.bias, row.slope, row.cut)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row.

    labels (doc_id, toxic) teaches; a label other than 0 or 1 is no label, two labels of a document count as toxic if
    either does. Rows with crc32(doc_id as text) mod 5 = 0 are held out of training; a null doc_id is never a training
    row. A null, empty or wordless text gets the score of no evidence. Repeated rows get equal scores. Without both
    labels in the sample every score is the share of toxic ones. Empty docs give an empty result; other columns play
    no part. Training reads at most about train_docs labelled documents, in one task.
    """
    slim = docs.select(identifier(docs, id_col), docs[text_col].cast("string").alias("text"))
    scored = score(slim, train(slim, labels, train_docs))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of docs that toxicity() predicts as 0, all columns; each row by its own text, whatever its id."""
    slim = docs.select(identifier(docs, id_col), docs[text_col].cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(slim, labels, train_docs))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_probabilities(shared.value, batch.column(at).cast(pa.string())) < 0.5))

    return docs.mapInArrow(run, docs.schema)
