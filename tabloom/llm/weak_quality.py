"""Quality by weak labels (operator 2).

Eight heuristic labellers vote good, bad or abstain on every document. Their votes are counted by pattern over all
documents (a table of at most 3 ** 8 rows, pre-aggregated in Spark); expectation-maximisation over that table estimates
each labeller's accuracy, how often it speaks, and the share of good documents, without any gold label. The posterior
of a document's pattern is its training label: a logistic model over hashed word, word-shape and repetition features
learns it from a bounded sample and scores every whole text, also where all labellers abstain; the score alone decides
what is kept. Training is one executor task over hashed counts, of bounded size for each sampled document; the driver
sees the vote table and the weights only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, identifier, ids_array, mix, text_chunks

LABELLERS = ("symbols", "shouting", "pipes", "repeats", "vocabulary", "sentences", "word_length", "length")
#: These only ever vote bad, so their silence counts as a vote; that of the others says nothing.
ONE_SIDED = np.array([True, True, True, True, False, False, False, False])
BITS = 16
#: Documents that train the scorer at most, chosen by a hash of id and text.
TRAIN_DOCS = 5000
#: Words among which distinct ones are counted: the share means the same for texts of any length.
STRETCH = 100
#: Documents that the beliefs about labellers weigh as much as, whatever the size of the corpus; share of good documents
#: on which a labeller that watches for one defect may fire by mistake.
BELIEF, MISTAKES = 20.0, 0.005

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*!|@^~=<>{}[]\\"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?"]] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(total[offsets])


def measures(data: np.ndarray, offsets: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    """Per text: counts that the labellers read. One pass over the bytes for each."""
    n_bytes = np.maximum(1, np.diff(offsets))
    n = np.diff(words.first)
    some = np.maximum(1, n)
    sizes = words.ends - words.starts
    again = np.zeros(len(sizes), bool)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    again[words.first[:-1][n > 0]] = False
    odd = _SYMBOL[data[words.ends - 1]] if len(sizes) else np.zeros(0, bool)
    pipe = (data[words.starts] == 124) & (sizes == 1) if len(sizes) else odd
    stop = _STOP[data[words.ends - 1]] if len(sizes) else odd
    text_of = np.repeat(np.arange(len(n)), n)
    stretch = (np.arange(len(sizes)) - words.first[:-1][text_of]) // STRETCH + text_of * (len(sizes) + 1)
    order = np.lexsort((words.hashes, stretch))
    new = np.ones(len(order), bool)
    new[1:] = (words.hashes[order][1:] != words.hashes[order][:-1]) | (stretch[order][1:] != stretch[order][:-1])
    distinct = np.bincount(text_of[order][new], minlength=len(n))
    upper, lower = _per_text(_UPPER[data], offsets), _per_text(_LOWER[data], offsets)
    by = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[words.first]) / some
    return {"n": n, "symbols": by(odd), "upper": upper / np.maximum(1, upper + lower), "pipes": by(pipe), "again": by(again), "distinct": distinct / some, "stops": by(stop), "word_length": np.diff(np.concatenate([[0], np.cumsum(sizes)])[words.first]) / some, "letters": _per_text(_LETTER[data], offsets) / n_bytes}


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """One row per text: 1 good, 0 bad, -1 abstain for each labeller."""

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 1, -1))

    n = m["n"]
    none = np.zeros(len(n), bool)  # the absence of one defect says little about the others
    return np.stack(
        [
            vote(m["symbols"] > 0.3, none),
            vote((m["upper"] > 0.5) & (n > 3), none),
            vote(m["pipes"] > 0.15, none),
            vote(m["again"] > 0.2, none),
            vote((m["distinct"] < 0.2) & (n >= 20), (m["distinct"] > 0.4) & (n >= 20)),
            vote((m["stops"] < 0.01) & (n >= 20), m["stops"] > 0.05),
            vote((m["word_length"] > 15) | ((m["word_length"] < 2.5) & (n > 3)), (m["word_length"] > 3.5) & (m["word_length"] < 9)),
            vote(n < 1, n >= 50),
        ],
        axis=1,
    ).astype(np.int8)


def pattern_of(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each pattern, accuracies by class and vote, share of good documents).

    Per labeller and class a distribution over {abstain, bad, good} with a prior that a vote is right; silence of
    a labeller that is not one-sided carries no weight.
    """
    v = votes_of(patterns) + 1  # 0 abstain, 1 bad, 2 good
    m = v.shape[1]
    # beliefs: a labeller that speaks is right more often than not; they weigh as much as BELIEF documents, so the corpus
    # overrules them. A bad document has one defect, so without a bound on MISTAKES the classes could turn into one
    # frequent defect against all the rest
    prior = np.repeat(np.array([[0.2, 0.5, 0.3], [0.2, 0.1, 0.7]])[None], m, axis=0)
    prior[ONE_SIDED] = np.array([[0.7, 0.3, 1e-6], [0.98, 0.02, 1e-6]])
    prior *= BELIEF
    table = prior / prior.sum(axis=2, keepdims=True)
    heard = (v > 0) | ONE_SIDED
    share, posterior = 0.8, np.zeros(len(v))
    for _ in range(steps):
        logs = (np.log(table)[np.arange(m)[None, :], :, v] * heard[:, :, None]).sum(axis=1)
        odds = logs[:, 1] + np.log(share) - logs[:, 0] - np.log(1 - share)
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        weight = np.stack([counts * (1 - new), counts * new], axis=1)
        for j in range(m):
            for vote in range(3):
                table[j, :, vote] = weight[(v[:, j] == vote) & heard[:, j]].sum(axis=0)
        table = table + prior
        table /= table.sum(axis=2, keepdims=True)
        fired = np.minimum(table[ONE_SIDED, 1, 1], MISTAKES)
        table[ONE_SIDED, 1, 1], table[ONE_SIDED, 1, 0] = fired, 1 - fired - table[ONE_SIDED, 1, 2]
        share = float(np.clip(weight[:, 1].sum() / max(1, counts.sum()), 0.01, 0.99))
        if np.abs(new - posterior).max(initial=0) < 1e-9:
            break
        posterior = new
    return posterior, table, share


def hashed(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two feature codes of each word: the word itself, and its shape (first and last byte, length, repetition)."""
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = np.uint64((1 << BITS) - 1)
    kind = np.zeros(256, np.uint64)
    kind[_LETTER], kind[_UPPER], kind[48:58], kind[_SYMBOL], kind[_STOP] = 1, 2, 3, 4, 5
    last = data[words.ends - 1].astype(np.uint64)
    again = np.zeros(len(words.hashes), np.uint64)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    middle = kind[data[(words.starts + words.ends) // 2]]
    shape = kind[data[words.starts]] * np.uint64(64) + kind[last.astype(np.int64)] * np.uint64(8) + middle + np.uint64(512) * np.minimum(words.ends - words.starts, 15).astype(np.uint64) // np.uint64(4) * np.uint64(4) + again * np.uint64(1 << 20)
    return (words.hashes & mask).astype(np.int64), (mix(shape + np.uint64(12345)) & mask).astype(np.int64)


def _margin(weights: np.ndarray, data: np.ndarray, words: Words) -> np.ndarray:
    a, b = hashed(data, words)
    total = np.concatenate([[0.0], np.cumsum(weights[a] + weights[(1 << BITS) + b])])
    return np.diff(total[words.first]) / np.maximum(1, np.diff(words.first)) + weights[-1]


_VOTED = pa.schema([("doc_id", pa.int64()), ("pattern", pa.int32())])
_OUT = pa.schema([("doc_id", pa.int64()), ("pattern", pa.int32()), ("posterior", pa.float64()), ("score", pa.float64()), ("n_votes", pa.int32())])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in text_chunks(batch.column(1)):
            pattern = pattern_of(votes(measures(data, offsets, Words(data, offsets, fold=True))))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pattern, pa.int32())], schema=_VOTED)


def counted(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature codes of a text and their shares: at most twice 2 ** BITS of them, however long the text."""
    a, b = hashed(data, words)
    code, count = np.unique(np.concatenate([a, b + (1 << BITS)]), return_counts=True)
    return code, count / max(1, len(a))


def train(codes: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, epochs: int = 60, rate: float = 2.0) -> np.ndarray:
    """Logistic regression on mean feature values by full-batch Adam steps; weights of words, shapes and the constant."""
    weights = np.zeros((2 << BITS) + 1)
    if not len(target):
        return weights
    r, c, v = np.repeat(np.arange(len(codes)), [len(x) for x in codes]), np.concatenate(codes), np.concatenate(values)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, epochs + 1):
        margin = np.bincount(r, weights[c] * v, len(codes)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target) / len(codes)
        gradient = np.bincount(c, error[r] * v, len(weights)) + 1e-6 * weights
        gradient[-1] = error.sum()
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        weights -= rate * 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights


_SAMPLED = pa.schema([("key", pa.int64()), ("pattern", pa.int32()), ("codes", pa.binary()), ("shares", pa.binary())])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns in: key, text."""
    for batch in batches:
        for a, b, data, offsets in text_chunks(batch.column(1)):
            rows = []
            for k in range(b - a):
                own = data[offsets[k] : offsets[k + 1]]
                bounds = np.array([0, len(own)])
                words = Words(own, bounds, fold=True)
                code, share = counted(own, words)
                rows.append((int(pattern_of(votes(measures(own, bounds, words)))[0]), code.astype(np.int32).tobytes(), share.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(list(c), f.type) for c, f in zip(zip(*rows), list(_SAMPLED)[1:]))], schema=_SAMPLED)


def _fitted(known: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["key"], r["pattern"], r["codes"], r["shares"]) for b in batches for r in b.to_pylist())
        codes, shares = ([np.frombuffer(r[k], t) for r in rows] for k, t in ((2, np.int32), (3, np.float32)))
        weights = train(codes, shares, np.array([known.get(r[1], 0.5) for r in rows]))
        yield pa.RecordBatch.from_pylist([{"weights": weights.astype(np.float32).tobytes()}])

    return run


def weak_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, threshold: float = 0.5) -> DataFrame:
    """doc_id, pattern, n_votes, posterior, score, keep; one row per input row.

    pattern codes the votes (see votes_of), posterior is the label model's probability of a good document, score the
    scorer's, and keep is score >= threshold. A null text counts as empty: its labellers mostly abstain or vote bad. A
    null doc_id stays null. Repeated rows get equal results. An empty table gives an empty result; other columns play
    no part. The vote table covers all documents; the scorer learns from train_docs of them at most, of which rows that
    repeat id and text count once.
    """
    slim = docs.select(identifier(docs, id_col), docs[text_col].cast("string").alias("text"))
    voted = slim.mapInArrow(_vote, "doc_id long, pattern int")
    table = sorted((r.pattern, r["count"]) for r in voted.groupBy("pattern").count().collect())  # at most 3 ** 8 rows
    patterns, counts = np.array([p for p, _ in table], np.int64), np.array([c for _, c in table], float)
    posterior, _, _ = expectation_maximisation(patterns, counts)
    known = dict(zip(patterns.tolist(), posterior.tolist()))
    share = min(1.0, 2 * train_docs / max(1.0, counts.sum()))
    keyed = slim.select(F.xxhash64("doc_id", "text").alias("key"), "text").where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = keyed.mapInArrow(_features, "key long, pattern int, codes binary, shares binary").dropDuplicates(["key"]).orderBy("key").limit(train_docs)
    row = sample.repartition(1).mapInArrow(_fitted(known), "weights binary").first()
    weights = np.frombuffer(row.weights, np.float32).astype(float) if row else train([], [], np.zeros(0))
    shared = docs.sparkSession.sparkContext.broadcast((weights, known))  # a megabyte, for any input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, by_pattern = shared.value
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                words = Words(data, offsets, fold=True)
                v = votes(measures(data, offsets, words))
                pattern = pattern_of(v)
                score = 1 / (1 + np.exp(-np.clip(_margin(w, data, words), -30, 30)))
                believed = [by_pattern.get(p, 0.5) for p in pattern.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pattern, pa.int32()), pa.array(believed), pa.array(score), pa.array((v >= 0).sum(axis=1), pa.int32())], schema=_OUT)

    scored = slim.mapInArrow(run, "doc_id long, pattern int, posterior double, score double, n_votes int")
    return scored.select("doc_id", "pattern", "n_votes", "posterior", "score", (F.col("score") >= threshold).alias("keep"))
