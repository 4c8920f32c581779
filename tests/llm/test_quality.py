import itertools
import zlib

import numpy as np
import pytest
import rows as R

from chartspark.llm import book, quality

GOOD = ["Thand the ation of it was here. One more of those, said the other.", "He went on, and they were with it again.\nThe rest was ordinary.", "A last and quiet sentence of words."]
BAD = ["AND!! THE!! OTHER!! ONES!!", "home | about | us | more | log in |", "the the the the the the and and and and"]


@pytest.mark.parametrize("block", [2, 3, 1 << 15])
def test_marginals_by_listing_all_labels(monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK_LINES", block)
    rng = np.random.default_rng(1)
    scores, moves, sizes = rng.normal(size=9) * 3, rng.normal(size=(2, 2)), [4, 1, 3, 1]
    is_first, weights = np.zeros(9, bool), rng.random(9)
    is_first[np.cumsum([0, *sizes[:-1]])] = True
    found, at, pairs = quality.Marginals(scores, is_first, moves), 0, np.zeros((2, 2))
    for size in sizes:
        total, good, both = 0, np.zeros(size), np.zeros((size, 2, 2))
        for labels in itertools.product((0, 1), repeat=size):
            p = np.exp(sum(scores[at + i] * x for i, x in enumerate(labels)) + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
            total += p
            good += p * np.array(labels)
            for i in range(1, size):
                both[i, labels[i - 1], labels[i]] += p
        np.testing.assert_allclose(found.good[at : at + size], good / total)
        pairs += sum(weights[at + i] * both[i] / total for i in range(1, size))
        at += size
    np.testing.assert_allclose(found.pairs(weights), pairs)


def test_features_by_ordinary_code():
    texts = ["Ab cd cd!\n\nAb cd cd!", "", "é é# 12.", "\n", "AB"]
    data, offsets = quality._view([t.encode() for t in texts])
    x, chars, hashes, first = quality.line_features(data, offsets)
    lines = [line for t in texts for line in t.split("\n")]
    assert first.tolist() == np.cumsum([0, *[t.count("\n") + 1 for t in texts]]).tolist() and chars.tolist() == [len(line) for line in lines]
    column = lambda name: x[:, quality.FEATURES.index(name)]
    for i, line in enumerate(lines):
        size, words = max(len(line.encode()), 1), line.split()
        assert column("empty")[i] == (line == "")
        assert column("upper")[i] == pytest.approx(sum(c.isascii() and c.isupper() for c in line) / size)
        assert column("digits")[i] == pytest.approx(sum(c.isdigit() for c in line) / size)
        assert column("distinct_words")[i] == pytest.approx(len({w.lower() for w in words}) / len(words) if words else 1)
        assert column("repeated_word")[i] == pytest.approx(sum(a.lower() == b.lower() for a, b in zip(words, words[1:])) / max(len(words), 1))
        assert column("sign_ends")[i] == pytest.approx(sum(w[-1] in "#!" for w in words) / max(len(words), 1))
        assert column("ends_sentence")[i] == (line[-1:] in (".", "!")) * 1.0
    assert quality.repeated(hashes, first).tolist() == [0, 0, 1, 0, 0, 0, 0, 0]


def test_long_texts_are_scored_as_whole(monkeypatch):
    rng = np.random.default_rng(2)
    field = quality.Field(rng.normal(size=quality.WEIGHTS), rng.normal(size=(2, 2)))
    text = "\n".join(rng.choice(GOOD + BAD + ["", "x y z"], 500).tolist()).encode()
    whole = field.score([text, b"", b"short"])
    monkeypatch.setattr(quality.arrays, "PIECE_BYTES", 300)
    monkeypatch.setattr(quality, "BLOCK_LINES", 64)
    np.testing.assert_allclose(field.score([text, b"", b"short"]), whole)


def labelled(spark, n=60):
    rng = np.random.default_rng(3)
    texts = ["\n".join(rng.choice(GOOD if i % 2 else BAD, rng.integers(1, 6)).tolist()) + f"\n{i}" for i in range(n)]
    return R.documents(spark, texts), spark.createDataFrame([(i, i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int")


def test_learns_and_handles_edges(spark):
    docs, labels = labelled(spark)
    field = quality.train(R.clashing(docs), labels)
    texts = [GOOD[0], BAD[0], None, "", "\n" * 1000, BAD[2] + " the" * 500_000, "\n".join(GOOD * 1000)]
    found = quality.score(R.clashing(R.documents(spark, texts, ids=[0, 1, 2, 3, None, 5, 5])), field).collect()
    score = [r.score for r in found]
    assert [r.doc_id for r in found] == [0, 1, 2, 3, None, 5, 5] and all(0 <= s <= 1 for s in score)
    assert score[0] > 0.7 > 0.3 > score[1] and score[2] == score[3] and score[5] < 0.3 < score[6]
    assert quality.score(docs.limit(0), field).collect() == []


def test_training_is_bounded_repeatable_and_ignores_copies(spark):
    docs, labels = labelled(spark)
    once = quality.train(docs, labels)
    again = quality.train(docs.unionByName(docs.limit(20)).repartition(5), labels.unionByName(labels.limit(10)))
    np.testing.assert_allclose(once.weights, again.weights)
    few = quality.train(docs, labels, most=10)
    assert not np.allclose(few.weights, once.weights)


def test_without_labels_every_score_is_a_half(spark):
    docs, labels = labelled(spark, 4)
    odd = spark.createDataFrame([(0, None), (None, 1), (1, 7), (99, 1)], "doc_id long, quality int")
    for table in (labels.limit(0), odd):
        assert {r.score for r in quality.score(docs, quality.train(docs, table)).collect()} == {0.5}


def test_query_on_held_out_documents(spark):
    found = {r.doc_id: r for r in book.op11_line_field_quality(spark, "/root/testdata/sf0.01").collect()}
    for doc_id, r in found.items():
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [i for i in labels if found[i].held_out]
    assert len(held) > 50 and sum(found[i].predicted == labels[i] for i in held) >= 0.97 * len(held)
