"""Conversation prefix trie: adaptive radix trees over fixed-width turn ids, built on sorted ranges of keys and joined at their seams.

A turn's id has 20 bytes: 16 of the hash of role and text, then the text's length, big-endian. A conversation's key is the chain
of its turns' ids. Copies of a key become one row with their number before any tree is built. Distinct keys are dealt out by
ranges and sorted; every task builds radix trees over blocks of neighbouring keys. Inner nodes hold 4, 16, 48 or 256 children and
grow as needed, runs of single children are one compressed path, and only depths that are whole turns are given out.

A node strictly between a block's first and last key is complete there. Nodes on the paths of these two keys may go on in
neighbouring blocks: blocks give their parts, which are added up by node, and the sums of such nodes over their subtrees are
taken on two paths a block. So no step needs a whole tree or subtree in one place, whatever turn or prefix is frequent.

One conversation's chain of ids (20 bytes a turn, never its texts) is one value, so a conversation must fit into a row; its members'
id list is hashed in order, as SHA-256 requires, but comes in pieces and is never held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartspark import scale
from chartspark.llm import arrays

DIGEST = 16
WIDTH = DIGEST + 4
HEADS = 6  # a conversation takes up to HEADS - 1 turns of the one its group is named after
GROUP = 100
BLOCK_KEYS = 4096
BLOCK_BYTES = 4 << 20
PIECE_CHARS = 1 << 16


# --- the tree ---


class Few:
    """Up to 4 or 16 children: their bytes in order, beside them the children."""

    __slots__ = ("bytes", "nodes", "most")

    def __init__(self, most: int, entries=()) -> None:
        self.most = most
        self.bytes = bytearray(b for b, _ in entries)
        self.nodes = [n for _, n in entries]

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.nodes[at]

    def full(self) -> bool:
        return len(self.nodes) == self.most

    def put(self, byte: int, node) -> None:
        at = self.bytes.find(byte)
        if at >= 0:
            self.nodes[at] = node
            return
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)

    def entries(self) -> list:
        return list(zip(self.bytes, self.nodes))

    def grown(self):
        return Few(16, self.entries()) if self.most == 4 else Indexed(self.entries())


class Indexed:
    """Up to 48 children behind an index of 256 places."""

    __slots__ = ("index", "nodes")

    def __init__(self, entries=()) -> None:
        self.index, self.nodes = bytearray(256), []
        for byte, node in entries:
            self.put(byte, node)

    def get(self, byte: int):
        at = self.index[byte]
        return self.nodes[at - 1] if at else None

    def full(self) -> bool:
        return len(self.nodes) == 48

    def put(self, byte: int, node) -> None:
        if self.index[byte]:
            self.nodes[self.index[byte] - 1] = node
        else:
            self.nodes.append(node)
            self.index[byte] = len(self.nodes)

    def entries(self) -> list:
        return [(b, self.nodes[at - 1]) for b, at in enumerate(self.index) if at]

    def grown(self):
        return Direct(self.entries())


class Direct:
    """A place for each byte."""

    __slots__ = ("nodes",)

    def __init__(self, entries=()) -> None:
        self.nodes = [None] * 256
        for byte, node in entries:
            self.nodes[byte] = node

    def get(self, byte: int):
        return self.nodes[byte]

    def full(self) -> bool:
        return False

    def put(self, byte: int, node) -> None:
        self.nodes[byte] = node

    def entries(self) -> list:
        return [(b, n) for b, n in enumerate(self.nodes) if n is not None]


class Node:
    """A compressed path, what ends behind it, and the children by their next byte."""

    __slots__ = ("path", "value", "children")

    def __init__(self, path: bytes, value=None, children=None) -> None:
        self.path, self.value, self.children = path, value, children or Few(4)

    def add(self, byte: int, node: Node) -> None:
        if self.children.get(byte) is None and self.children.full():
            self.children = self.children.grown()
        self.children.put(byte, node)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


class RadixTree:
    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        """Keys are told apart by their bytes; a key may be the start of another. A later equal key replaces the value."""
        node, at, parent, by = self.root, 0, None, 0
        while True:
            same = _shared(node.path, key[at : at + len(node.path)])
            if same < len(node.path):  # the path splits here
                upper = Node(node.path[:same])
                upper.add(node.path[same], node)
                node.path = node.path[same + 1 :]
                if parent is None:
                    self.root = upper
                else:
                    parent.children.put(by, upper)
                node = upper
            at += same
            if at == len(key):
                node.value = value
                return
            below = node.children.get(key[at])
            if below is None:
                node.add(key[at], Node(key[at + 1 :], value))
                return
            parent, by, node, at = node, key[at], below, at + 1

    def walk(self, step: int) -> Iterator[tuple[int, bytes, object]]:
        """(depth in steps, last step, value or None) of each path that ends on a whole step, parents first, in key order."""
        path = bytearray()
        todo = [(self.root, 0, None)]
        while todo:
            node, length, byte = todo.pop()
            del path[length:]
            start = len(path)
            if byte is not None:
                path.append(byte)
            path += node.path
            # the step at start itself was given out by the node above, but for the root
            for depth in range(start // step + (1 if byte is not None else 0), len(path) // step + 1):
                end = depth * step
                yield depth, bytes(path[max(end - step, 0) : end]), node.value if end == len(path) else None
            todo += [(child, len(path), b) for b, child in reversed(node.children.entries())]


# --- blocks of keys ---


class Entry:
    """A trie node within a block, with the sums of what the block has below it."""

    __slots__ = ("parent", "depth", "digest", "chars", "n", "first", "ends", "children", "leaves", "saved", "side")

    def __init__(self, parent: Entry | None, depth: int, step: bytes, value) -> None:
        self.parent, self.depth = parent, depth
        self.digest = hashlib.sha256((parent.digest if parent else b"") + step).digest()[:DIGEST]
        self.chars = int.from_bytes(step[DIGEST:], "big")
        self.n, self.first, self.ends = value or (0, None, None)
        self.children = self.leaves = self.saved = 0
        self.side = ""


def block_entries(rows: list[tuple[bytes, int, int, str]]) -> list[Entry]:
    """Entries of a block's sorted distinct keys (key, members, smallest member, hash of the members), parents first.

    side is "low" on the path of the first key, "high" on the rest of the last key's path, else empty. Entries without a side have
    their final numbers; the others have the sums over their complete children only.
    """
    tree = RadixTree()
    for key, n, first, ends in rows:
        tree.insert(key, (n, first, ends))
    entries: list[Entry] = []
    line: list[Entry] = []  # the path to the last entry
    ended: list[Entry] = []  # in key order
    for depth, step, value in tree.walk(WIDTH):
        del line[depth:]
        line.append(Entry(line[-1] if line else None, depth, step, value))
        entries.append(line[-1])
        if value is not None:
            ended.append(line[-1])
    for entry, side in ((ended[0], "low"), (ended[-1], "high")):
        while entry is not None and not entry.side:
            entry.side = side
            entry = entry.parent
    for entry in reversed(entries):
        if not entry.side:
            entry.leaves += entry.children == 0
            entry.saved += (entry.n - 1) * entry.chars
        above = entry.parent
        if above is None:
            continue
        above.n += entry.n
        above.first = entry.first if above.first is None else min(above.first, entry.first)
        if not entry.side:
            above.children += 1
            above.leaves += entry.leaves
            above.saved += entry.saved
    return entries


_ENTRY = pa.schema([
    ("block", pa.int64()), ("side", pa.string()), ("node", pa.binary()), ("parent", pa.binary()), ("parent_first", pa.int64()), ("depth", pa.int64()),
    ("chars", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("ends", pa.string()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()),
])
_ENTRY_SQL = "block long, side string, node binary, parent binary, parent_first long, depth long, chars long, n long, first long, ends string, children long, leaves long, saved long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the blocks of one sorted range of keys."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def out() -> pa.RecordBatch:
        rows = []
        for e in block_entries(held):
            # a complete parent has all its members here
            above = e.parent
            known = above.first if above is not None and not above.side else None
            rows.append((number, e.side, e.digest, above and above.digest, known, e.depth, e.chars, e.n, e.first, e.ends, e.children, e.leaves, e.saved))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRY)], schema=_ENTRY)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            size += len(row[0])
            if len(held) >= BLOCK_KEYS or size >= BLOCK_BYTES:
                yield out()
                number, held, size = number + 1, [], 0
    if held:
        yield out()
    arrays.give_back()


# --- keys ---


def _turn_id(role: Column, text: Column) -> Column:
    """20 bytes: the start of the hash of role and text, kept apart by the role's length, and the text's code points."""
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.unhex(F.substring(F.sha2(named.cast("binary"), 256), 1, 2 * DIGEST)), F.unhex(F.lpad(F.hex(F.length(text).cast("long")), 8, "0")))


def conversation_keys(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, key of its own turns in order as an array of ids.

    Turns follow their number, null first; turns of one number follow their ids. Rows without conv_id are left out.
    """
    body = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), _turn_id(*body).alias("id"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "id")))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: t["id"]).alias("ids"))


def rebuilt_keys(own: DataFrame) -> DataFrame:
    """conv_id, key: the first h turns of the group's conversation, then the own ones after the first h; h is a hash of the id."""
    own = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")})
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("ids", 1, HEADS - 1).alias("head"))
    none = F.array().cast("array<binary>")
    # at most 2 * GROUP - 1 conversations share a base
    both = own.join(heads, "base", "left")
    ids = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("ids", F.col("h") + 1, F.greatest(F.size("ids") - F.col("h"), F.lit(0))))
    joined = F.unhex(F.array_join(F.transform(ids, F.hex), ""))
    return both.select("conv_id", joined.alias("key"))


_PIECES = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("ids", pa.string())])
_KEYS = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("first", pa.int64()), ("ends", pa.string())])


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of conversations with one key as (digest, smallest id, number, key, ids joined by commas), in pieces."""
    held: list | None = None  # digest, key, ids, characters

    for batch in batches:
        rows = []
        for digest, conv_id, key in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or held[0] != digest or held[3] >= PIECE_CHARS:
                if held is not None:
                    rows.append((held[0], held[2][0], len(held[2]), held[1], ",".join(map(str, held[2]))))
                held = [digest, key, [], 0]
            held[2].append(conv_id)
            held[3] += 20
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _PIECES)], schema=_PIECES)
    if held is not None:
        row = (held[0], held[2][0], len(held[2]), held[1], ",".join(map(str, held[2])))
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _PIECES)], schema=_PIECES)


def _joined_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to (key, n, first, ends), ends being the hash of all ids; one piece is held at a time."""
    digest, key, n, first, ends = None, None, 0, 0, None
    for batch in batches:
        rows = []
        for own, low, count, own_key, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if ends is None or own != digest:
                if ends is not None:
                    rows.append((key, n, first, ends.hexdigest()))
                digest, key, n, first, ends = own, own_key, 0, low, hashlib.sha256()
            else:
                ends.update(b",")
            ends.update(ids.encode())
            n += count
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _KEYS)], schema=_KEYS)
    if ends is not None:
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip((key, n, first, ends.hexdigest()), _KEYS)], schema=_KEYS)


def distinct_keys(keys: DataFrame) -> DataFrame:
    """key, n (conversations with it), first (smallest id), ends (hash of their ids, ascending, joined by commas).

    Ranges of (key, id) spread a frequent key over tasks; what meets again by key is pieces of joined ids.
    """
    pieces = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keys.select(F.unhex(F.sha2("key", 256)).alias("digest"), "conv_id", "key")
    spread = rows.repartitionByRange(pieces, "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    parts = spread.mapInArrow(_id_pieces, "digest binary, first long, n long, key binary, ids string")
    met = parts.repartition(pieces, "digest").sortWithinPartitions("digest", "first")
    return met.mapInArrow(_joined_pieces, "key binary, n long, first long, ends string")


# --- the trie ---


def _open_nodes(parts: DataFrame) -> DataFrame:
    """Nodes that several blocks may share, added up: block, node, first, n, children, leaves, saved, ends, and whether the block is their first."""
    total = parts.groupBy("node").agg(
        F.min("block").alias("home"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("ends").alias("ends"), F.sum("children").alias("own_children"),
        F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.any_value("chars").alias("chars"),
    )
    below = total.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("open_children"))
    total = scale.cut_lineage(total.join(below, "node", "left").withColumn("children", F.col("own_children") + F.coalesce("open_children", F.lit(0))))
    # a node's complete children count where they are, its own weight in its first block only
    own = {"leaves": (F.col("t.children") == 0).cast("long"), "saved": (F.col("t.n") - 1) * F.col("t.chars")}
    met = parts.alias("p").join(total.alias("t"), "node").select(
        "block", "side", "node", F.col("p.depth").alias("depth"), *[(F.col(f"p.{k}") + F.when(F.col("block") == F.col("home"), c).otherwise(0)).alias(k) for k, c in own.items()],
    )
    # the high path leaves the low one at one node, below all shared ones
    path, block = W.partitionBy("block", "side").orderBy(F.col("depth").desc()), W.partitionBy("block")
    split = F.min(F.when(F.col("side") == "high", F.col("depth"))).over(block)
    shared = (F.col("side") == "low") & (F.col("depth") < split)
    under = lambda c: F.sum(c).over(path.rowsBetween(W.unboundedPreceding, 0)) + F.when(shared, F.sum(F.when(F.col("side") == "high", F.col(c))).over(block)).otherwise(0)
    sums = met.select("node", under("leaves").alias("leaves"), under("saved").alias("saved")).groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return total.join(sums, "node").select("node", "parent", "depth", "n", "first", "ends", "children", "leaves", "saved")


def nodes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per trie node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null role and text count as empty, turns of one number follow their ids, repeated rows are turns each, and rows without conv_id
    are left out. A conversation without turns after rebuilding ends at the root; an empty table has no node. Other columns are ignored.
    """
    spark = turns.sparkSession
    own = scale.cut_lineage(conversation_keys(turns, conv_id, turn, role, text))
    keys = scale.cut_lineage(distinct_keys(rebuilt_keys(own)))
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = keys.repartitionByRange(pieces, "key").sortWithinPartitions("key").select("key", "n", "first", "ends")
    parts = scale.cut_lineage(ranges.mapInArrow(_blocks, _ENTRY_SQL))
    seams = scale.cut_lineage(_open_nodes(parts.where("side != ''")))
    # who lies under an open node asks in its own block, so a frequent parent is asked for in many places
    names = parts.where("side != ''").select("block", F.col("node").alias("parent")).join(seams.select(F.col("node").alias("parent"), F.col("first").alias("open_first")), "parent")
    done = parts.where("side = ''").join(names, ["block", "parent"], "left").withColumn("parent_first", F.coalesce("parent_first", "open_first"))
    above = seams.select(F.col("node").alias("parent"), F.col("first").alias("parent_first"))
    columns = ["first", "depth", "parent_first", "n", "children", "leaves", "saved", "ends"]
    every = done.select(columns).unionByName(seams.join(above, "parent", "left").select(columns))
    empty = hashlib.sha256(b"").hexdigest()
    return every.select(
        F.col("first").alias("conv_id"), "depth", F.col("parent_first").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(empty)).alias("ends_sha256"),
    )
