"""Document quality by a linear-chain conditional random field over lines.

Every line has features of its characters and words; its label, good or bad, depends on its own features, those of the line
before and after, and the label of the line before. Training takes each line's label from its document. A document's score
is the mean of its lines' marginal probabilities of good, weighted by their lengths.

Marginals come from forward and backward products of 2 x 2 matrices. The first line of a text has a matrix with equal rows, so
the products of many texts can run as one chain: nothing crosses such a row. Products are taken by doubling within blocks of
lines, and only one vector is carried from block to block, so memory for a long text is a few numbers a line.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark.llm import arrays

TRAIN_DOCS = 4000  # at most so many labelled texts train the field
TRAIN_LINES = 500  # texts of more lines are scored, but not trained on
STEPS = 200
RATE = 0.2
DECAY = 1e-4
BLOCK_LINES = 1 << 15
THRESHOLD = 0.3

#: Features of a line, in order; the last is found on the whole text.
FEATURES = (
    "always", "empty", "length", "upper", "digits", "marks", "shouts", "signs", "spaces", "beyond_ascii", "word_length", "repeated_word",
    "distinct_words", "sign_ends", "ends_sentence", "starts_upper", "repeated_line",
)
_EDGES = 2  # first line, last line
WEIGHTS = 3 * len(FEATURES) + _EDGES


def _bytes(*chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in "".join(chars)]] = True
    return out


_UPPER, _DIGIT = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789")
_MARK, _SHOUT, _SIGN, _SPACE = _bytes(".,;:?'\"()-"), _bytes("!"), _bytes("#$%&*+/<=>@[\\]^_`{|}~"), _bytes(" \t\r\x0b\x0c")
_STOP = _bytes(".?!:;")
_WORD = ~_bytes(" \t\n\r\x0b\x0c")


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features without the last, code points, hash, first line of each text and total) of the lines of texts.

    A text has one line more than line ends.
    """
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    first = np.arange(len(offsets)) + np.searchsorted(breaks, offsets)
    ends = np.empty_like(starts)
    if len(starts):
        ends[:-1], ends[-1] = starts[1:], n
        ends[np.setdiff1d(np.arange(len(starts)), first[1:] - 1)] -= 1  # the line end, but for the last line of a text
    total = np.empty(n + 1, np.int32 if n < 1 << 31 else np.int64)
    total[0] = 0

    def count(mask: np.ndarray) -> np.ndarray:
        np.cumsum(mask, out=total[1:])
        return (total[ends] - total[starts]).astype(np.float64)

    size = np.maximum(ends - starts, 1).astype(np.float64)
    empty = ends == starts
    w_starts, w_ends, hashes, _ = arrays.words(data, offsets, _WORD)
    w_first = np.searchsorted(w_starts, np.append(starts, n))
    words = np.diff(w_first)
    some = np.maximum(words, 1).astype(np.float64)
    line = np.repeat(np.arange(len(starts)), words)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    own = arrays.mix(hashes ^ arrays.mix(line.astype(np.uint64) + np.uint64(1)))
    _, kept = np.unique(own, return_index=True)
    per_line = lambda picked: np.bincount(line[picked], minlength=len(starts)).astype(np.float64)
    signed = np.flatnonzero((_SIGN | _SHOUT)[data[w_ends - 1]]) if len(w_ends) else np.zeros(0, np.int64)
    low, high = np.minimum(starts, max(n - 1, 0)), np.maximum(ends - 1, 0)
    edge = lambda kind, at: np.where(empty, False, kind[data[at]]) if n else np.zeros(len(starts))
    chars = count((data & 0xC0) != 0x80)
    columns = [
        np.ones(len(starts)), empty, np.log1p(chars) / 8, count(_UPPER[data]) / size, count(_DIGIT[data]) / size, count(_MARK[data]) / size,
        count(_SHOUT[data]) / size, count(_SIGN[data]) / size, count(_SPACE[data]) / size, count(data >= 128) / size,
        np.minimum(np.bincount(line, weights=w_ends - w_starts, minlength=len(starts)) / some / 16, 2.0),
        per_line(np.flatnonzero(again)) / some, np.where(words > 0, per_line(kept) / some, 1.0), per_line(signed) / some,
        edge(_STOP, high), edge(_UPPER, low),
    ]
    x = np.stack([np.broadcast_to(np.asarray(c, np.float32), len(starts)) for c in columns], axis=1) if len(starts) else np.zeros((0, len(columns)), np.float32)
    # a line's hash: the sum of its words' hashes, each turned by its place in the line
    place = np.arange(len(hashes)) - w_first[line] if len(hashes) else np.zeros(0, np.int64)
    running = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(arrays.mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), out=running[1:])
    return x, chars, running[w_first[1:]] - running[w_first[:-1]], first


def repeated(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 for a line with words whose like stands earlier in its text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(np.uint64)
    _, earliest = np.unique(arrays.mix(hashes ^ arrays.mix(text + np.uint64(1))), return_index=True)
    out = np.ones(len(hashes), np.float32)
    out[earliest] = 0
    return np.where(hashes == 0, 0, out)


def _chunks(text: bytes) -> list[bytes]:
    """A long text in parts of whole lines; a line longer than a part is one of its own."""
    parts, start = [], 0
    while len(text) - start > arrays.PIECE_BYTES:
        cut = text.find(b"\n", start + arrays.PIECE_BYTES)
        if cut < 0:
            break
        parts.append(text[start:cut])
        start = cut + 1
    return [*parts, text[start:]]


def _view(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


# --- the field ---


def _times(a: tuple, b: tuple) -> tuple:
    """Products of 2 x 2 matrices given as four arrays, scaled to a largest element of 1."""
    out = (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3])
    top = np.maximum(np.maximum(out[0], out[1]), np.maximum(out[2], out[3]))
    return tuple(o / top for o in out)


def _scan(m: tuple, forward: bool) -> tuple:
    """Products of each place with all before it (forward) or all after it, by doubling the reach."""
    n, reach = len(m[0]), 1
    while reach < n:
        near = _times(tuple(x[:-reach] for x in m), tuple(x[reach:] for x in m))
        if forward:
            m = tuple(np.concatenate([x[:reach], y]) for x, y in zip(m, near))
        else:
            m = tuple(np.concatenate([y, x[-reach:]]) for x, y in zip(m, near))
        reach *= 2
    return m


class Marginals:
    """Forward and backward messages of a chain of lines; scores[t] speaks for good at t, is_first marks first lines of texts."""

    def __init__(self, scores: np.ndarray, is_first: np.ndarray, moves: np.ndarray) -> None:
        n = len(scores)
        self.alpha, self.beta = np.empty((n, 2)), np.empty((n, 2))
        self.step = np.exp(moves - moves.max())  # [before, now]; 1 is good
        self.emission = np.stack([np.exp(np.minimum(-scores, 0)), np.exp(np.minimum(scores, 0))], axis=1)
        self.is_first = is_first
        left, blocks = np.ones(2), range(0, n, BLOCK_LINES)
        for a in blocks:
            p = _scan(self._matrices(a, a + BLOCK_LINES), True)
            alpha = np.stack([left[0] * p[0] + left[1] * p[2], left[0] * p[1] + left[1] * p[3]], axis=1)
            self.alpha[a : a + BLOCK_LINES] = alpha / alpha.sum(axis=1, keepdims=True)
            left = self.alpha[min(a + BLOCK_LINES, n) - 1]
        right = np.ones(2)
        for a in reversed(blocks):
            s = _scan(self._matrices(a, a + BLOCK_LINES), False)
            beta = np.stack([s[0] * right[0] + s[1] * right[1], s[2] * right[0] + s[3] * right[1]], axis=1)
            beta /= beta.sum(axis=1, keepdims=True)
            self.beta[a : a + len(beta) - 1], self.beta[a + len(beta) - 1] = beta[1:], right
            right = beta[0]
        both = self.alpha * self.beta
        self.good = both[:, 1] / both.sum(axis=1)

    def _matrices(self, a: int, b: int) -> tuple:
        e, reset = self.emission[a:b], self.is_first[a:b]
        return tuple(np.where(reset, 1.0, self.step[i, j]) * e[:, j] for i in range(2) for j in range(2))

    def pairs(self, weights: np.ndarray) -> np.ndarray:
        """Weighted sums of the probabilities of each pair of neighbouring labels within texts."""
        inner = np.flatnonzero(~self.is_first)
        p = self.alpha[inner - 1][:, :, None] * self.step * (self.emission[inner] * self.beta[inner])[:, None, :]
        p *= (weights[inner] / p.sum(axis=(1, 2)))[:, None, None]
        return p.sum(axis=0)


def _with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each line, the one before, the one after, and whether it is the first or last of its text."""
    lines = len(x)
    is_first, is_last = np.zeros(lines, bool), np.zeros(lines, bool)
    is_first[first[:-1]], is_last[first[1:] - 1] = True, True
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[is_first], after[is_last] = 0, 0
    return np.concatenate([x, before, after, is_first[:, None], is_last[:, None]], axis=1)


class Field:
    """Weights of the line features with neighbours, and of the moves between labels."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    @classmethod
    def fit(cls, x: np.ndarray, first: np.ndarray, good: np.ndarray, steps: int = STEPS) -> Field:
        """Gradient ascent with adapted step widths on the likelihood; every text counts alike, whatever its number of lines.

        good is a label a text. Without texts all weights are 0 and every score is a half.
        """
        weights, moves = np.zeros(WEIGHTS), np.zeros((2, 2))
        if len(good) == 0:
            return cls(weights, moves)
        full, sizes = _with_neighbours(x, first).astype(np.float64), np.diff(first)
        label, share = np.repeat(good, sizes), np.repeat(1.0 / sizes / len(good), sizes)
        is_first = np.zeros(len(x), bool)
        is_first[first[:-1]] = True
        held = share * ~is_first
        seen = np.array([[held[label == 0].sum(), 0.0], [0.0, held[label == 1].sum()]])
        mean, spread = np.zeros(WEIGHTS + 4), np.zeros(WEIGHTS + 4)
        for step in range(1, steps + 1):
            found = Marginals(full @ weights, is_first, moves)
            up = np.concatenate([full.T @ (share * (label - found.good)) - DECAY * weights, (seen - found.pairs(share) - DECAY * moves).ravel()])
            mean, spread = 0.9 * mean + 0.1 * up, 0.99 * spread + 0.01 * up**2
            move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
            weights, moves = weights + move[:WEIGHTS], moves + move[WEIGHTS:].reshape(2, 2)
        return cls(weights, moves)

    def score(self, texts: list[bytes]) -> list[float]:
        """Length-weighted mean of the lines' marginals of each text; lines without characters count alike if there are no others."""
        k = len(FEATURES)
        own = np.stack([self.weights[:k], self.weights[k : 2 * k], self.weights[2 * k : 3 * k]], axis=1)
        parts = [_chunks(t) for t in texts]
        said, chars, hashes, sizes = [], [], [], []
        for group in [[p for part in parts for p in part]] if sum(map(len, texts)) <= 2 * arrays.PIECE_BYTES else [[p] for part in parts for p in part]:
            x, c, h, first = line_features(*_view(group))
            said.append(x @ own[:-1])
            chars.append(c)
            hashes.append(h)
            sizes += np.diff(first).tolist()
        said, chars, hashes = map(np.concatenate, (said, chars, hashes))
        at = np.cumsum([0, *sizes])
        first = at[np.cumsum([0, *map(len, parts)])]
        said += repeated(hashes, first)[:, None] * own[-1]
        is_first, is_last = np.zeros(len(said), bool), np.zeros(len(said), bool)
        is_first[first[:-1]], is_last[first[1:] - 1] = True, True
        scores = said[:, 0] + self.weights[-2] * is_first + self.weights[-1] * is_last
        scores[1:] += np.where(is_first[1:], 0, said[:-1, 1])
        scores[:-1] += np.where(is_last[:-1], 0, said[1:, 2])
        good = Marginals(scores, is_first, self.moves).good
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        length = np.bincount(text, weights=chars, minlength=len(texts))
        weight = np.where(length[text] > 0, chars, 1.0)
        return (np.bincount(text, weights=weight * good, minlength=len(texts)) / np.bincount(text, weights=weight, minlength=len(texts))).tolist()


# --- Spark ---


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_DOCS) -> Field:
    """A field from the texts that a label 0 or 1 names by id.

    Learns from at most ``most`` distinct texts of at most TRAIN_LINES lines, chosen by hash; copies are one text, and a text with
    both labels counts as good by their share, rounded half up. Null text counts as empty; null ids and other labels train nothing.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), body.alias("body")).where("id IS NOT NULL")
    keyed = rows.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))
    lines = F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit(""))) + 1
    named = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("good")).where("good IN (0, 1)")
    slim = keyed.where(lines <= TRAIN_LINES).select("id", "digest").join(named, "id")
    texts = slim.groupBy("digest").agg(F.min("id").alias("id"), F.floor(F.avg("good") + 0.5).cast("double").alias("good"))
    picked = texts.orderBy(F.xxhash64("digest"), "digest").limit(most)  # a bounded table
    sample = keyed.join(F.broadcast(picked), ["id", "digest"]).dropDuplicates(["digest"]).select("digest", "good", "body")

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column(2).cast(pa.large_binary()).to_pylist():
                x, _, hashes, first = line_features(*_view([body]))
                rows.append(np.concatenate([x, repeated(hashes, first)[:, None]], axis=1).astype("<f4").tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["digest", "good", "x"])

    found = sample.mapInArrow(lines_of, "digest string, good double, x binary").toArrow().sort_by("digest")
    x = [np.frombuffer(v, "<f4").reshape(-1, len(FEATURES)) for v in found.column("x").to_pylist()]
    first = np.cumsum([0, *map(len, x)])
    return Field.fit(np.concatenate(x) if x else np.zeros((0, len(FEATURES))), first, found.column("good").to_numpy())


def scorer(field: Field, docs: DataFrame) -> Column:
    """A column function of text: the score, a double from 0 to 1."""
    sent, name = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves)), uuid.uuid4().hex

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = arrays.worker_cache("quality")
        if cache.get("field", (None,))[0] != name:
            cache["field"] = (name, Field(*sent.value))
        own = cache["field"][1]
        for texts in batches:
            out = []
            for piece in arrays.pieces(texts.cast(pa.large_string())):
                out += own.score([t or b"" for t in piece.cast(pa.large_binary()).to_pylist()])
            yield pa.array(out, pa.float64())
        arrays.give_back()

    return F.arrow_udf(scored, T.DoubleType()).asNondeterministic()


def score(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher for better text).

    Null counts as the empty text, which is one line without characters. Equal texts have equal scores. Other columns are ignored.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), scorer(field, docs)(F.col(text).cast("string")).alias("score"))
