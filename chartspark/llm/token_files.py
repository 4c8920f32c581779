"""Token files: documents in id order, or a given one, as one stream of token ids, cut into fixed blocks of transposed, compressed planes.

Layout. A folder of Parquet files, one or more a shard; shards follow each other in the order of their numbers. Each row
is one block of ``BLOCK_IDS`` ids (the last of a shard may hold fewer):

- ``shard, chunk, first, n_ids``: the chunk index; first is the place of the block's first id within its shard
- ``row, doc_id, begin, length, last``: for each document with ids in the block its number within the shard, its id, the
  place and number of its ids in the block, and whether they are its last ones
- ``plane_bits, planes``: the ids as little-endian 32-bit numbers, transposed into 4 byte planes (8) or 32 bit planes (1),
  each a zstandard frame. Readers of the index alone skip the planes.

A document's ids end with the end id, so each document has at least one id and shards without documents have no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark import scale
from chartspark.llm import arrays

BLOCK_IDS = 1 << 16
END_ID = 0
TEXT_BYTES = 2 << 20
SEGMENT_CHARS = 1 << 20
CACHED_WORDS = 600_000  # beyond this, a worker keeps the words of its current texts only
LEVEL = 3

_ARROW_BLOCK = pa.schema([
    ("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("row", pa.list_(pa.int64())),
    ("doc_id", pa.list_(pa.int64())), ("begin", pa.list_(pa.int32())), ("length", pa.list_(pa.int32())), ("last", pa.list_(pa.bool_())),
    ("plane_bits", pa.int32()), ("planes", pa.list_(pa.binary())),
])
_BLOCK = (
    "shard int, chunk int, first long, n_ids int, row array<long>, doc_id array<long>, begin array<int>, length array<int>, "
    "last array<boolean>, plane_bits int, planes array<binary>"
)


# --- planes ---


def to_planes(ids: np.ndarray, bits: int = 8) -> list[bytes]:
    """Byte planes (bits=8) or bit planes (bits=1) of unsigned 32-bit ids, lowest first, each compressed."""
    import zstandard

    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if bits == 1:
        octets = np.concatenate([np.packbits(np.unpackbits(np.ascontiguousarray(o)[:, None], axis=1, bitorder="little").T, axis=1) for o in octets])
    packer = zstandard.ZstdCompressor(level=LEVEL)
    return [packer.compress(np.ascontiguousarray(plane).tobytes()) for plane in octets]


def from_planes(planes: list[bytes], n: int, bits: int = 8) -> np.ndarray:
    import zstandard

    opener = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(opener.decompress(p), np.uint8) for p in planes]
    if bits == 1:
        single = [np.unpackbits(p, count=n) for p in raw]
        raw = [np.packbits(np.stack(single[i : i + 8], axis=1), axis=1, bitorder="little")[:, 0] for i in range(0, 32, 8)]
    return np.ascontiguousarray(np.stack(raw, axis=1)).view("<u4")[:, 0]


# --- text to ids ---


class Encoder:
    """Ids of whole texts by the tokenizers library, as bytes of little-endian 32-bit numbers.

    A byte-level vocabulary never joins what stands before a single space to what stands after it, if neither neighbour is
    white space. Texts are cut there, and every distinct piece is encoded once and then looked up. A text with other
    spacing is encoded as it is. The strings of the vocabulary's special tokens in a text give their ids, as in the library; if one
    holds a space, nothing is cut.
    """

    _PLAIN = re.compile(r"[!-~¡-ɏ](?:.*[!-~¡-ɏ])?", re.DOTALL)
    _CUT = re.compile(r"(?<=[!-~¡-ɏ]) (?=[!-~¡-ɏ])")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.opens[number] = token.startswith("Ġ")  # the vocabulary's sign for a space
        self.known: dict[str, bytes | None] = {}
        self.can_cut = self._cuts_exactly()

    def _cuts_exactly(self) -> bool:
        if any(" " in token.content for token in self.tokenizer.get_added_tokens_decoder().values()):
            return False
        sample = "Some words, it's 12 or 3.5 (more)\nlines; café ok."
        parts = sample.split(" ")
        return self._raw(sample) == b"".join(self._raw(" " + p if i else p) for i, p in enumerate(parts))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _raw(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > CACHED_WORDS:  # frequent words are in any large piece of text
            self.known = {w: self.known[w] for w in words if w in self.known}
        new = words.difference(self.known)
        plain = [w for w in new if self._PLAIN.fullmatch(w)]
        self.known.update(dict.fromkeys(new))  # None: not to be cut here
        if not plain:
            return
        ids = self._ids(" " + " ".join(plain))
        cuts = (np.flatnonzero(self.opens[ids]) * 4).tolist()
        raw = ids.tobytes()
        if len(cuts) == len(plain):
            self.known.update(zip(plain, [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]))
        else:
            self.known.update((w, self._raw(" " + w)) for w in plain)

    def _segments(self, text: str) -> list[str]:
        """Parts of a very long text, cut where that changes no id."""
        parts, start = [], 0
        while self.can_cut and len(text) - start > SEGMENT_CHARS:
            cut = self._CUT.search(text, start + SEGMENT_CHARS)
            if cut is None:
                break
            parts.append(text[start : cut.start()])
            start = cut.start()
        return [*parts, text[start:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.can_cut:
            return [b"".join(map(self._raw, self._segments(t))) for t in texts]
        split = [[s.split(" ") for s in self._segments(t)] for t in texts]
        words, heads = set(), set()
        for parts in split:
            for part in parts:
                heads.add(part[0])
                words.update(part)
        self._learn(words)
        heads = sorted(heads)
        head = dict(zip(heads, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(heads, add_special_tokens=False))))
        return [b"".join([self._part(part, head) for part in parts]) for parts in split]

    def _part(self, words: list[str], head: dict[str, bytes]) -> bytes:
        """Ids of a text's words. An empty first one is a leading space: that of the text, or the cut of a long one."""
        if len(words) > 1 and (not words[0] or self._PLAIN.fullmatch(words[0])):
            try:
                return head[words[0]] + b"".join(map(self.known.__getitem__, islice(words, 1, None)))
            except TypeError:  # a word that is not to be cut off
                pass
        return head[words[0]] if len(words) == 1 else self._raw(" ".join(words))


# --- writing ---


class _Blocks:
    """Gathers the ids of one shard and gives out full blocks."""

    def __init__(self, shard: int, size: int, bits: int) -> None:
        self.shard, self.size, self.bits = shard, size, bits
        self.chunk, self.first, self.rows, self.held = 0, 0, 0, 0
        self.parts: list[bytes] = []
        self.docs: list[tuple] = []

    def add(self, doc_id: int | None, raw: bytes) -> Iterator[dict]:
        at, total = 0, len(raw) // 4
        while at < total:
            take = min(self.size - self.held, total - at)
            self.docs.append((self.rows, doc_id, self.held, take, at + take == total))
            self.parts.append(raw[at * 4 : (at + take) * 4])
            self.held += take
            at += take
            if self.held == self.size:
                yield self.block()
        self.rows += 1

    def block(self) -> dict:
        row, doc_id, begin, length, last = (list(x) for x in zip(*self.docs))
        out = {
            "shard": self.shard, "chunk": self.chunk, "first": self.first, "n_ids": self.held, "row": row, "doc_id": doc_id, "begin": begin,
            "length": length, "last": last, "plane_bits": self.bits, "planes": to_planes(np.frombuffer(b"".join(self.parts), "<u4"), self.bits),
        }
        self.chunk, self.first, self.held, self.parts, self.docs = self.chunk + 1, self.first + self.held, 0, [], []
        return out


def write(
    docs: DataFrame, tokenizer: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
    block_ids: int = BLOCK_IDS, plane_bits: int = 8, shards: int | None = None, order: tuple[Column, ...] = (),
) -> str:
    """Write the documents' ids in ascending doc_id order and return the folder (a new one in the shared folder by default).

    Null text counts as empty, null ids come first; rows that repeat an id follow each other in the order of their texts'
    md5. Other columns are ignored. The text is shuffled once, by ranges of id and md5, so many rows of one id are spread
    too; encoding and writing share that stage, so a lost task costs its own range only. Columns in order, ascending, take
    the place of id and md5; they should tell all rows apart.
    """
    spark = docs.sparkSession
    folder = folder or f"{scale.shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    given = order or (F.col(doc_id).cast("long"), F.md5(body.cast("binary")))
    keys = [f"key_{i}" for i in range(len(given))]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("body"), *[c.alias(k) for c, k in zip(given, keys)])
    ordered = rows.repartitionByRange(shards, *keys).sortWithinPartitions(*keys)
    stop = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = arrays.worker_cache("tokens")
        if ("encoder", tokenizer) not in cache:
            cache["encoder", tokenizer] = Encoder(tokenizer)
        encoder = cache["encoder", tokenizer]
        gathered = _Blocks(TaskContext.get().partitionId(), block_ids, plane_bits)
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for piece in arrays.pieces(batch.column(1), TEXT_BYTES):
                full = []
                for raw in encoder.encode(piece.to_pylist()):
                    full += gathered.add(ids[at], raw + stop)
                    at += 1
                if full:
                    yield pa.RecordBatch.from_pylist(full, _ARROW_BLOCK)
        if gathered.held:
            yield pa.RecordBatch.from_pylist([gathered.block()], _ARROW_BLOCK)
        arrays.give_back()

    ordered.mapInArrow(blocks, _BLOCK).write.option("compression", "none").parquet(folder)
    return folder


def stored_order() -> tuple[Column, ...]:
    """The order of rows in a Parquet folder that Spark has written: number of the task, of its file, place in the file."""
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).cast("long")
    return number(r"^part-(\d+)-"), number(r"-c(\d+)\."), F.col("_metadata.row_index")


# --- reading ---


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for block in batch.to_pylist():
            ids = from_planes(block["planes"], block["n_ids"], block["plane_bits"])
            for row, doc_id, begin, length, last in zip(block["row"], block["doc_id"], block["begin"], block["length"], block["last"]):
                crc = zlib.crc32(ids[begin : begin + length].tobytes())
                out.append((block["shard"], row, doc_id, block["first"] + begin, length, crc, last))
        columns = list(zip(*out)) or [[]] * 7
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "row", "doc_id", "first", "length", "crc", "last"])


def join_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of two joined byte strings from theirs and the size of the second.

    The first remainder is carried over size zero bytes by squaring that step, as a product of polynomials over two elements.
    """

    def times(a: int, b: int) -> int:
        out = 0
        for i in range(32):
            if a >> (31 - i) & 1:
                out ^= b
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, step = 1 << 31, 1 << 23  # x**0 and x**8, lowest power in the highest bit
    while size:
        if size & 1:
            power = times(power, step)
        step = times(step, step)
        size >>= 1
    return times(power, first) ^ second


@F.arrow_udf(T.LongType())
def _joined_crc(parts: pa.Array) -> pa.Array:
    out = []
    for row in parts.to_pylist():
        crc = 0
        for part in row:
            crc = join_crc(crc, part["crc"], 4 * part["length"])
        out.append(crc)
    return pa.array(out, pa.int64())


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Blocks are decoded each on its own. Documents within one block are done there; the others join their parts' checksums.
    """
    blocks = spark.read.schema(_BLOCK).parquet(folder)
    parts = scale.cut_lineage(blocks.mapInArrow(_segments, "shard int, row long, doc_id long, first long, length long, crc long, last boolean"))
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = sizes.select("shard", (F.sum("ids").over(W.orderBy("shard")) - F.col("ids")).alias("before"))  # one row a shard
    split = parts.where(~F.col("last")).select("shard", "row").distinct().withColumn("split", F.lit(True))
    marked = parts.join(split, ["shard", "row"], "left")
    whole = marked.where("split IS NULL").select("shard", "doc_id", "first", F.col("length").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    joined = marked.where("split").groupBy("shard", "row").agg(
        F.min("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("length").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("first", "length", "crc"))).alias("parts"),
    )
    joined = joined.select("shard", "doc_id", "first", "n_tokens", _joined_crc("parts").alias("ids_crc32"))
    found = whole.unionByName(joined).join(before, "shard")
    return found.select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with their ids as arrays: shard, chunk, first, ids."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [from_planes(b["planes"], b["n_ids"], b["plane_bits"]).astype(np.int64) for b in batch.select(["planes", "n_ids", "plane_bits"]).to_pylist()]
            yield pa.record_batch([batch.column("shard"), batch.column("chunk"), batch.column("first"), arrays.lists(ids, pa.int64())], names=["shard", "chunk", "first", "ids"])

    return spark.read.schema(_BLOCK).parquet(folder).mapInArrow(decoded, "shard int, chunk int, first long, ids array<long>")
