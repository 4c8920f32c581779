import random
from collections import Counter, defaultdict

import numpy as np

import rows as R
from chartspark.llm import near_dedup


def sets_of(texts):
    out = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        out[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def brute(texts):
    """(id, size, smallest reachable id) with every pair that shares a shingle compared."""
    sets, parent = sets_of(texts), {i: i for i in texts}
    where = defaultdict(list)
    for i, s in sets.items():
        for shingle in s:
            where[shingle].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, common in Counter(j for shingle in s for j in where[shingle] if j < i).items():
            if 100 * common >= 75 * (len(s) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i)) for i in texts)


def result(docs):
    found = near_dedup.components(docs).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None)


def fixture():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(90)]
    texts = []
    for _ in range(60):  # a wide group: many pairs just above and below the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(90)] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(60)]
    texts += [" ".join(chain[i : i + 50]) for i in range(0, 11, 2)]  # each linked with the next ones only
    texts += [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(30)]
    passage = [word() for _ in range(12)]
    texts += [" ".join([word() for _ in range(40)] + passage) for _ in range(30)]
    texts += [None, "", " \n\t", "one two", "ONE two", "one two three", "one two three four five", "one  two\nthree four FIVE", "É a b c d e", "é a b c d e", "w " * 30_000]
    return texts


def test_components_against_all_pairs(spark):
    texts = fixture()
    assert result(R.clashing(R.documents(spark, texts))) == brute(dict(enumerate(texts)))


def test_query_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{R.SF}/documents.parquet")
    assert result(docs) == brute({r.doc_id: r.text for r in docs.collect()})


def test_repeated_rows_null_ids_and_keep_one(spark):
    same = "a b c d e f g h"
    docs = R.clashing(R.documents(spark, [same, same, same, "other words here", "q r s t u v", same, None], ids=[5, 5, 9, 9, 1, None, 3]))
    assert [(i, n) for i, n, _ in result(docs)] == [(1, 2), (3, 0), (5, 4), (5, 4), (9, 1), (9, 4)]
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids.count(1) == ids.count(3) == ids.count(5) == ids.count(None) == 1


def test_empty_table(spark):
    docs = R.documents(spark, [])
    assert near_dedup.components(docs).collect() == [] and near_dedup.keep_one(docs).collect() == []


def slow_signature(items, places):
    """The same signature shingle by shingle, with a whole permutation each and no early stop."""
    best = [(1 << 64) - 1] * places
    for item in items:
        order = list(range(places))
        for j in range(places):
            draw = near_dedup.arrays.mix(np.array([item], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            k = j + (int(draw[0]) >> 32) % (places - j)
            order[j], order[k] = order[k], order[j]
            best[order[j]] = min(best[order[j]], j << 56 | int(near_dedup.arrays.mix(draw)[0]) >> 8)
    return best


def test_signatures_equal_the_sequential_ones():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 0, 7, 40, 300)]
    found = near_dedup.signatures(sets, 24)
    for own, row in zip(sets, found):
        assert row.tolist() == slow_signature(own.tolist(), 24)


def test_equal_places_estimate_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(30):
        a = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
        b = np.unique(np.concatenate([a[:300], rng.integers(0, 1 << 63, 50).astype(np.uint64)]))
        x, y = near_dedup.signatures([a, b], 200)
        errors.append((x == y).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_labels_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 150)]
    found = {r.id: r.label for r in near_dedup.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 140)) and found[200] == found[150] == 150


def test_texts_under_one_id_are_compared_each(spark):
    words = [f"w{i}" for i in range(60)]
    near, far, lone = " ".join(words), " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    texts = [near, far, lone, near + " end", far + " end", far, None, ""]
    docs = R.clashing(R.documents(spark, texts, ids=[1, 1, 1, 2, 3, 1, 4, 4]))
    found = near_dedup.components(docs)
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(1, 1)] * 4 + [(2, 1), (3, 1), (4, 4), (4, 4)]
    for shuffled in (docs, docs.repartition(5, "text")):
        kept = sorted((r.doc_id, r.text or "") for r in near_dedup.keep_one(shuffled).collect())
        assert kept == sorted([(1, near), (1, far), (1, lone), (4, "")])
