"""Fill-in-the-middle by piece tables: documents are descriptors over immutable buffers, cutting and arranging never copies text.

A document starts as one descriptor over its own bytes. Cutting it at two places splits that descriptor into prefix, middle
and suffix; an arrangement permutes the three and puts descriptors over the sentinel buffers between them; the inverse
permutation brings a sample back to its document. Hashes and lengths are streamed over the descriptors. A sample is written
out only for the output column.

Cuts fall between units: runs of ASCII letters, or single other characters. Which units, which form and whether a document
stays plain are read from a hash of its id. Map only, nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark.llm import arrays

#: Buffers of the table: the document's own one, then the sentinels.
TEXT, PREFIX, SUFFIX, MIDDLE = range(4)
SENTINELS = ("<P>", "<S>", "<M>")
#: Each form as the order of its parts, every one led by its sentinel; parts are numbered prefix 0, middle 1, suffix 2.
FORMS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
PLAIN = "plain"
PLAIN_FROM = 90  # of 100: documents with a higher draw stay as they are
SPM_BELOW = 20  # of 100: documents with a lower draw take the spm form
SEED = 1
SEGMENT_BYTES = 1 << 20

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


class Piece(NamedTuple):
    """A descriptor: bytes [start, end) of a buffer."""

    buffer: int
    start: int
    end: int


class PieceTable:
    """An ordered list of descriptors over buffers that never change."""

    def __init__(self, buffers: tuple[bytes, ...], pieces: tuple[Piece, ...]) -> None:
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text: bytes, sentinels: tuple[bytes, ...]) -> PieceTable:
        return cls((text, *sentinels), (Piece(TEXT, 0, len(text)),))

    def cut(self, *places: int) -> PieceTable:
        """Split descriptors at byte places of the table's sequence; a place at an edge leaves an empty descriptor."""
        out, rest, at = [], list(self.pieces), 0
        for place in sorted(places):
            while rest and at + rest[0].end - rest[0].start < place:
                at += rest[0].end - rest[0].start
                out.append(rest.pop(0))
            buffer, start, end = rest.pop(0)
            out.append(Piece(buffer, start, start + place - at))
            rest.insert(0, Piece(buffer, start + place - at, end))
            at = place
        return PieceTable(self.buffers, (*out, *rest))

    def arranged(self, form: str) -> PieceTable:
        """Three parts in the order of the form, with descriptors of the sentinels between them."""
        out = []
        for sentinel, part in FORMS[form]:
            out += [Piece(sentinel, 0, len(self.buffers[sentinel])), self.pieces[part]]
        return PieceTable(self.buffers, tuple(out))

    def restored(self, form: str) -> PieceTable:
        """The inverse of arranged: parts in document order, without sentinels."""
        parts = {part: self.pieces[2 * i + 1] for i, (_, part) in enumerate(FORMS[form])}
        return PieceTable(self.buffers, tuple(parts[i] for i in range(3)))

    def stream(self) -> Iterator[memoryview]:
        views = [memoryview(b) for b in self.buffers]
        for buffer, start, end in self.pieces:
            yield views[buffer][start:end]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def chars(self, piece: int) -> int:
        """Code points of one descriptor, counted segment by segment."""
        buffer, start, end = self.pieces[piece]
        data = np.frombuffer(self.buffers[buffer], np.uint8)
        return sum(int(np.count_nonzero((data[a : min(a + SEGMENT_BYTES, end)] & 0xC0) != 0x80)) for a in range(start, end, SEGMENT_BYTES))

    def bytes(self) -> bytes:
        return b"".join(self.stream())


def _unit_starts(text: bytes) -> Iterator[np.ndarray]:
    """Byte places where units start, segment by segment."""
    data = np.frombuffer(text, np.uint8)
    for a in range(0, len(data), SEGMENT_BYTES):
        here = data[a : a + SEGMENT_BYTES]
        letter = _IS_LETTER[here]
        after = np.empty(len(here), bool)
        after[0], after[1:] = a > 0 and _IS_LETTER[data[a - 1]], letter[:-1]
        yield np.flatnonzero(((here & 0xC0) != 0x80) & ~(letter & after)) + a


def units(text: bytes) -> int:
    return sum(map(len, _unit_starts(text)))


def unit_places(text: bytes, wanted: list[int]) -> list[int]:
    """Byte place before each unit of these numbers; the number of units stands for the end."""
    found, before = dict.fromkeys(wanted, len(text)), 0
    for starts in _unit_starts(text):
        for number in found:
            if before <= number < before + len(starts):
                found[number] = int(starts[number - before])
        before += len(starts)
    return [found[number] for number in wanted]


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The first four groups of eight hexadecimal digits of the hash of seed and id; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


class Sample(NamedTuple):
    n: int
    form: str
    table: PieceTable

    def row(self) -> dict:
        parts = None if self.form == PLAIN else self.table.restored(self.form)
        return {
            "n": self.n, "form": self.form, "prefix_chars": parts and parts.chars(0), "middle_chars": parts and parts.chars(1),
            "output": self.table.bytes().decode(), "output_sha256": self.table.sha256(), "pieces": [p._asdict() for p in self.table.pieces],
        }


def sample(text: bytes, doc_id: int | None, sentinels: tuple[bytes, ...], seed: int = SEED) -> Sample:
    n, (h1, h2, h3, h4) = units(text), draws(doc_id, seed)
    table = PieceTable.of(text, sentinels)
    if not text or h3 % 100 >= PLAIN_FROM or any(s in text for s in sentinels):
        return Sample(n, PLAIN, table)
    cuts = unit_places(text, [h1 % (n + 1), h2 % (n + 1)])
    form = "spm" if h4 % 100 < SPM_BELOW else "psm"
    return Sample(n, form, table.cut(*cuts).arranged(form))


def parsed(output: bytes, form: str, sentinels: tuple[bytes, ...]) -> PieceTable:
    """A written sample as descriptors over itself. No sentinel stands in a part, so each one's first place is its own."""
    if form == PLAIN:
        return PieceTable.of(output, sentinels)
    marks = []
    for sentinel, _ in FORMS[form]:
        word = sentinels[sentinel - 1]
        at = output.find(word, marks[-1][1] if marks else 0)
        if at < 0 or (not marks and at > 0):
            raise ValueError(f"no {form} sample")
        marks.append((at, at + len(word)))
    pieces = []
    for (start, end), (following, _) in zip(marks, [*marks[1:], (len(output), 0)]):
        pieces += [Piece(TEXT, start, end), Piece(TEXT, end, following)]
    return PieceTable((output, *sentinels), tuple(pieces)).restored(form)


_PIECES = T.ArrayType(T.StructType([T.StructField("buffer", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SAMPLE = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()), T.StructField("output_sha256", T.StringType()), T.StructField("pieces", _PIECES),
])
_ARROW_SAMPLE = pa.struct([
    ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()),
    ("output_sha256", pa.string()), ("pieces", pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))),
])


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) of pieces of bounded size; null is empty."""
    at = 0
    for piece in arrays.pieces(column.cast(pa.large_string())):
        yield at, [t or b"" for t in piece.cast(pa.large_binary()).to_pylist()]
        at += len(piece)


def samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentinels: tuple[str, str, str] = SENTINELS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, pieces (buffer, start, end in bytes).

    Null text counts as empty. Empty texts, texts with a sentinel in them and a tenth of the rest are plain: one piece, output
    is the text, no part lengths. Buffer 0 is the text, 1 to 3 are the sentinels. Equal ids draw alike, whatever their texts;
    repeated rows give equal samples. Other columns are ignored.
    """
    words = tuple(s.encode() for s in sentinels)

    @F.arrow_udf(_SAMPLE)
    def made(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in batches:
            names, rows = ids.to_pylist(), []
            for at, group in _texts(texts):
                part = [sample(t, names[at + i], words, seed).row() for i, t in enumerate(group)]
                rows.append(pa.array(part, _ARROW_SAMPLE))
            yield pa.concat_arrays(rows) if rows else pa.array([], _ARROW_SAMPLE)
        arrays.give_back()

    found = made.asNondeterministic()(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    return docs.select(F.col(doc_id).alias("doc_id"), found.alias("sample")).select("doc_id", "sample.*")


def _over_parsed(kind: T.DataType, arrow: pa.DataType, sentinels: tuple[str, str, str], result):
    words = tuple(s.encode() for s in sentinels)

    @F.arrow_udf(kind)
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            names, rows = forms.to_pylist(), []
            for at, group in _texts(outputs):
                rows += [result(parsed(t, names[at + i], words)) for i, t in enumerate(group)]
            yield pa.array(rows, arrow)

    return read


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The document of a written sample: its parts, found again by the sentinels, in their first order."""
    return _over_parsed(T.StringType(), pa.string(), sentinels, lambda table: table.bytes().decode())(output, form)


def restored_sha256(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """Hash of the document of a written sample, streamed over the descriptors without writing the document out."""
    return _over_parsed(T.StringType(), pa.string(), sentinels, PieceTable.sha256)(output, form)
