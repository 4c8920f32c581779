import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import rows as R
from pyspark.sql import functions as F

from chartspark.llm import book, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes by ordinary code from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], len(text), (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if rebuilt[c] == path)
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def random_rows(seed, convs=150, turns=9, words=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(np.arange(-120, 420), convs, replace=False).tolist():
        for t in range(int(rng.integers(1, turns))):
            rows.append((c, t, str(rng.choice(["user", "assistant"])), "é" * int(rng.integers(0, words))))
    return rows


@pytest.mark.parametrize("keys", [1, 2, 7, 4096])
def test_seams_of_blocks(spark, monkeypatch, keys):
    """Whatever the blocks, the nodes are those of one tree."""
    monkeypatch.setattr(prefix_trie, "BLOCK_KEYS", keys)
    rows = random_rows(keys)
    held = [(k, 1, i, "") for i, k in enumerate(sorted({bytes(prefix_trie.WIDTH * [ord(ch)]) + bytes(prefix_trie.WIDTH * [ord(d)]) for ch in "abc" for d in "xyz"}))]
    assert [e.depth for e in prefix_trie.block_entries(held)] == [0] + 3 * [1, 2, 2, 2]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert found(prefix_trie.nodes(df)) == brute(rows)


def test_small_blocks_in_tasks(spark):
    """The block size travels with the functions, so it is set inside the module that tasks get."""
    size, prefix_trie.BLOCK_KEYS = prefix_trie.BLOCK_KEYS, 2
    try:
        rows = random_rows(77, convs=200)
        parts = prefix_trie.nodes(spark.createDataFrame(rows, TURNS))
        assert found(parts) == brute(rows)
    finally:
        prefix_trie.BLOCK_KEYS = size


def test_hot_first_turn_copies_and_chains(spark):
    rows = [(c, t, "user", "same" if t < 2 else f"{c % 3}") for c in range(100, 400) for t in range(1 + c % 4)]  # a hot first turn, copies, prefixes of each other
    rows += [(1000 + c, t, "user", "x") for c in range(20) for t in range(c)]
    rows += [(5, t, "user", f"{t}") for t in range(120)]  # a long one
    assert found(prefix_trie.nodes(spark.createDataFrame(rows, TURNS))) == brute(rows)


def test_a_very_long_conversation(spark):
    rows = [(c, t, "user", "x") for c, n in ((100, 5000), (200, 5)) for t in range(n)]
    depths = [r.depth for r in prefix_trie.nodes(spark.createDataFrame(rows, TURNS)).collect()]
    assert sorted(depths) == list(range(5001))


def test_nulls_ties_repeats_extra_columns(spark):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, 0, "user", None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "a", "b"), (2, 5, "", ""), (0, 1, "user", "x" * 2_000_000), (-7, 0, "u:ser", "1:x"), (3, 0, "1", ":x")]
    df = spark.createDataFrame(rows, TURNS).withColumns({n: F.lit("clash") for n in ("id", "key", "base", "h", "head", "node", "parent", "block", "first", "ids", "digest", "n")})
    assert found(prefix_trie.nodes(df)) == brute(rows)
    assert found(prefix_trie.nodes(df.where("conv_id IS NULL"))) == [] and found(prefix_trie.nodes(df.limit(0))) == []


def test_turnless_conversation_is_a_member_of_the_root(spark):
    lone = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(lone, 0, "user", "gone")]
    assert found(prefix_trie.nodes(spark.createDataFrame(rows, TURNS))) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_layouts_grow_and_hold_every_key():
    rng = np.random.default_rng(5)
    keys = sorted({bytes([1, 2, i]) for i in range(30)} | {bytes(rng.integers(0, 256, int(n), dtype=np.uint8)) for n in rng.integers(0, 4, 3000)} | {bytes([7] * n) for n in range(300)})
    for order in (keys, keys[::-1], [keys[i] for i in rng.permutation(len(keys))]):
        tree = prefix_trie.RadixTree()
        for key in order:
            tree.insert(key, key)
        assert [value for _, _, value in tree.walk(1) if value is not None] == keys
        kinds, todo = set(), [tree.root]
        while todo:
            node = todo.pop()
            kinds.add((type(node.children).__name__, getattr(node.children, "most", 0)))
            todo += [n for _, n in node.children.entries()]
        assert kinds == {("Few", 4), ("Few", 16), ("Indexed", 0), ("Direct", 0)}


def test_query_against_ordinary_code(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{R.SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(book.op13_radix_prefix_trie(spark, R.SF)) == brute(rows)
