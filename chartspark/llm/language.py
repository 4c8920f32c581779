"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels the spans.

Training counts hashed runs of two to four characters (word edges marked) of labelled texts and turns them into one table
of log shares, with one column a language. A word's score for a language is the sum over its runs. Languages without
notable use of the word's script in training are no candidates for it. The path over the words pays a fixed penalty for each
switch of language, so that stretches of mixed text get their own label and single odd words do not.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark.llm import arrays

BUCKETS = 1 << 16
RUN_LENGTHS = (2, 3, 4)
SWITCH_PENALTY = 8.0
EXCLUDED = -1000.0
PATH_CELLS = 4 << 20  # words x languages whose paths are searched together
SCRIPT_SHARE = 0.01
TRAIN_DOCS = 4000  # about so many labelled documents of a language are read for the table
UNKNOWN = "und"

# fixed values: first code points of blocks, and the script from there on
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFF21, "latin"), (0xFF5B, "other"), (0xFF66, "kana"), (0xFFA0, "other"),
    (0x20000, "han"), (0x32000, "other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its one-character lower case, and its script number plus one if it is a letter, else 0."""
    cache = arrays.worker_cache("language")
    if "letters" not in cache:
        lower = np.arange(0x110000, dtype=np.uint32)
        kind = np.zeros(0x110000, np.uint8)
        script = np.zeros(0x110000, np.uint8)
        for first, name in SCRIPTS:
            script[first:] = SCRIPT_NAMES.index(name) + 1
        for c in range(0x110000):
            char = chr(c)
            if unicodedata.category(char)[0] == "L":
                kind[c] = script[c]
                small = char.lower()
                if len(small) == 1:
                    lower[c] = ord(small)
        cache["letters"] = (lower, kind)
    return cache["letters"]


class Words:
    """Words (runs of letters) of a piece of texts: places, scripts and hashed runs of characters."""

    def __init__(self, texts: list[str]) -> None:
        lower, kind = _tables()
        sizes = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])  # a break before, between and after the texts
        codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        scripts = kind[codes]
        inside = scripts > 0
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.script = scripts[self.starts]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.small = np.where(inside, lower[codes], 32).astype(np.uint32)

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket of the run of this many characters at each place, and for each word the places [low, high) of its runs.

        A word's runs may take in one break on either side, so they differ from runs inside longer words.
        """
        h = np.full(max(len(self.small) - length + 1, 0), length, np.uint32)
        for i in range(length):
            h = (h ^ self.small[i : i + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        low = self.starts - 1
        return h % np.uint32(BUCKETS), low, np.maximum(self.ends + 2 - length, low)


class Model:
    """Log shares of character runs, one column a language, and the languages that each script allows."""

    def __init__(self, languages: list[str], scores: np.ndarray, allowed: np.ndarray) -> None:
        self.languages, self.scores, self.allowed = languages, scores, allowed

    def word_scores(self, words: Words) -> np.ndarray:
        scores = np.zeros((len(words.starts), len(self.languages)), np.float32)
        for length in RUN_LENGTHS:
            bucket, low, high = words.runs(length)
            total = np.zeros((len(bucket) + 1, len(self.languages)))
            np.cumsum(self.scores[bucket], axis=0, out=total[1:])
            scores += total[high] - total[low]
        allowed = self.allowed[words.script]
        scores[~allowed] = EXCLUDED
        scores[~allowed.any(axis=1)] = 0  # a script that no language uses says nothing
        return scores

    def label(self, groups: Iterator[list[str]]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, share of the letters, spans (start, end, language)) of each text of the groups, in order."""
        held: list[tuple[Words, np.ndarray]] = []
        for texts in groups:
            words = Words(texts)
            held.append((words, self.word_scores(words)))
            if sum(s.size for _, s in held) > PATH_CELLS:
                yield from self._paths(held)
                held = []
        yield from self._paths(held)

    def _paths(self, held: list[tuple[Words, np.ndarray]]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        if not held:
            return
        scores = np.concatenate([s for _, s in held])
        shift = np.cumsum([0, *[len(s) for _, s in held]])
        first = np.concatenate([w.first[:-1] + at for (w, _), at in zip(held, shift)] + [shift[-1:]])
        path = viterbi(scores, first, SWITCH_PENALTY) if self.languages else None
        for (words, _), at in zip(held, shift.tolist()):
            letters = words.ends - words.starts
            for a, b, base in zip(words.first[:-1].tolist(), words.first[1:].tolist(), words.offsets.tolist()):
                if a == b or path is None:
                    yield UNKNOWN, 0.0, []
                    continue
                own, size = path[at + a : at + b], letters[a:b]
                votes = np.bincount(own, weights=size, minlength=len(self.languages))
                known = int(votes.argmax())
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), b - a]
                spans = [(int(words.starts[a + i]) - base, int(words.ends[a + j - 1]) - base, self.languages[own[i]]) for i, j in zip(cuts, cuts[1:])]
                yield self.languages[known], float(votes[known] / votes.sum()), spans


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best path of labels for each text; scores has a row a word, first the row where each text begins, and the total.

    All texts advance together, one word a step; the longest come first, so that the active ones are a prefix.
    """
    path = np.zeros(len(scores), np.int32)
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    lengths, starts = lengths[order], first[:-1][order]
    if not len(scores):
        return path
    back = np.zeros(scores.shape, np.uint8 if scores.shape[1] <= 256 else np.int32)
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    own = np.arange(scores.shape[1])
    value = scores[starts[: active[0]]].copy()
    ends = np.empty(len(lengths), np.int64)
    for t in range(1, int(lengths[0]) + 1):
        n = active[t] if t < lengths[0] else 0
        if n < len(value):
            ends[n : len(value)] = value[n:].argmax(axis=1)
            value = value[:n]
        if not n:
            break
        top = value.argmax(axis=1)
        switched = value[np.arange(n), top] - penalty
        stay = value >= switched[:, None]
        rows = starts[:n] + t
        back[rows] = np.where(stay, own, top[:, None])
        value = np.where(stay, value, switched[:, None]) + scores[rows]
    state = ends
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = active[t]
        rows = starts[:n] + t
        path[rows] = state[:n]
        state[:n] = back[rows, state[:n]]
    return path


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCS) -> Model:
    """A model from the rows whose lang is not null.

    Reads about per_language distinct whole texts of each language, chosen by the hash of the text, or all if there are fewer; copies
    are one text. Only hashes are shuffled to count them, and only chosen texts are moved. Without labelled texts there are no
    languages, and every text is und.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("body")).where("lang IS NOT NULL AND body IS NOT NULL")
    rows = rows.withColumns({"digest": F.md5(F.col("body").cast("binary")), "draw": F.pmod(F.xxhash64("body"), F.lit(1 << 30))})
    sizes = rows.select("lang", "digest").distinct().groupBy("lang").count().collect()  # a row a language
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES) + 1, 0), bool))
    limits = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1 << 30, (per_language << 30) // r["count"]))])
    chosen = rows.where(F.col("draw") < F.try_element_at(limits, F.col("lang")))
    picked = chosen.dropDuplicates(["lang", "digest"]).select("lang", "body")
    counted = picked.mapInArrow(_count_runs, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most languages x (buckets + scripts) rows
    names = np.array(found.column("lang").to_pylist(), object)
    features, n = found.column("feature").to_numpy(), found.column("n").to_numpy()
    languages = sorted(set(names.tolist()))
    counts = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((len(SCRIPT_NAMES) + 1, len(languages)))
    for column, name in enumerate(languages):
        own = names == name
        runs, marks = own & (features >= 0), own & (features < 0)
        counts[features[runs], column] = n[runs]
        scripts[-features[marks], column] = n[marks]
    scores = np.log((counts + 0.5) / (counts.sum(axis=0, keepdims=True) + 0.5 * BUCKETS))
    allowed = (scripts > 0) & (scripts >= SCRIPT_SHARE * scripts.sum(axis=0, keepdims=True))
    return Model(languages, scores.astype(np.float32), allowed)


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, feature, n): features from 0 are buckets, negative ones scripts."""
    runs: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for name in dict.fromkeys(langs.tolist()):
            total = runs.setdefault(name, np.zeros(BUCKETS, np.int64))
            own = scripts.setdefault(name, np.zeros(len(SCRIPT_NAMES) + 1, np.int64))
            for piece in arrays.pieces(batch.column(1).filter(pa.array(langs == name))):
                words = Words(piece.to_pylist())
                own += np.bincount(words.script, minlength=len(own))
                for length in RUN_LENGTHS:
                    bucket, low, high = words.runs(length)
                    inside = np.cumsum(np.bincount(low, minlength=len(bucket) + 1) - np.bincount(high, minlength=len(bucket) + 1))
                    total += np.bincount(bucket[inside[: len(bucket)] > 0], minlength=BUCKETS)
    for name, total in runs.items():
        used, marks = np.flatnonzero(total), np.flatnonzero(scripts[name])
        features = np.concatenate([used, -marks]).astype(np.int32)
        n = np.concatenate([total[used], scripts[name][marks]])
        yield pa.record_batch([pa.array([name] * len(features), pa.string()), pa.array(features), pa.array(n)], names=["lang", "feature", "n"])


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
_LABEL = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(_SPAN))])


def labeller(model: Model, docs: DataFrame) -> Callable[[Column], Column]:
    """A column function: text to struct<lang, score, spans>; und with score 0 for null and letterless texts."""
    sent, name = docs.sparkSession.sparkContext.broadcast((model.languages, model.scores, model.allowed)), uuid.uuid4().hex
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))])

    def labelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = arrays.worker_cache("language")
        if cache.get("language model", (None,))[0] != name:
            cache["language model"] = (name, Model(*sent.value))
        own = cache["language model"][1]
        for texts in batches:
            groups = ([t or "" for t in piece.to_pylist()] for piece in arrays.pieces(texts))
            rows = [{"lang": x, "score": score, "spans": [{"start": a, "end": b, "lang": y} for a, b, y in spans]} for x, score, spans in own.label(groups)]
            yield pa.array(rows, kind)
        arrays.give_back()

    return F.arrow_udf(labelled, _LABEL).asNondeterministic()


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang, score (share of the letters on the path), spans of equal language.

    Null, empty and letterless texts: und, 0, no spans. Equal votes: the language that comes first. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), labeller(model, docs)(F.col(text).cast("string")).alias("_label"))
    return rows.select("doc_id", "_label.*")


def accepted(docs: DataFrame, model: Model, languages: list[str] | None = None, least: float = 0.5, text: str = "text") -> DataFrame:
    """docs with the same columns, without those of no language, of one not listed, or with a share below least."""
    label, own = labeller(model, docs)(F.col(text).cast("string")), arrays.fresh_name(docs, "label")
    right = (F.col(f"{own}.lang") != UNKNOWN) & (F.col(f"{own}.score") >= least)
    if languages is not None:
        right &= F.col(f"{own}.lang").isin(languages)
    return docs.withColumn(own, label).where(right).drop(own)
