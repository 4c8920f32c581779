import binascii
import itertools

import numpy as np
import pytest

import rows as R
from chartspark.llm import book, language

ENGLISH = "the cat sat on the mat and then this other one went with them through that thing there while they thought "
GERMAN = "der hund und die katze sind nicht auf dem dach sondern unter einem baum weil ich das schon gesehen habe "
RUSSIAN = "это просто длинный текст который никто не читает потому что здесь ничего нет "


@pytest.fixture(scope="module")
def model(spark):
    texts = [ENGLISH * 5, GERMAN * 5, RUSSIAN * 5, ENGLISH, None, GERMAN]
    return language.train(R.clashing(R.documents(spark, texts, langs={0: "en", 1: "de", 2: "ru", 3: "en", 4: "de"})))


def labels(spark, model, texts):
    return language.identify(R.clashing(R.documents(spark, texts)), model).orderBy("doc_id").collect()


def test_spans_of_mixed_text(spark, model):
    text = (ENGLISH * 2 + GERMAN * 2 + RUSSIAN).strip()
    row = labels(spark, model, [text])[0]
    assert [s.lang for s in row.spans] == ["en", "de", "ru"]
    borders = [len(ENGLISH * 2), len(ENGLISH * 2 + GERMAN * 2)]
    assert [s.start for s in row.spans][1:] == borders and row.spans[0].start == 0 and row.spans[-1].end == len(text)
    assert row.lang == "en" or row.lang == "de"


def test_edges(spark, model):
    texts = [None, "", " 123 !?\n", "the", "漢字", ENGLISH + "漢字 " + ENGLISH, "кот", "İ ſ K " + GERMAN, "x" * 50_000, GERMAN * 3000]
    found = labels(spark, model, texts)
    assert [(r.lang, r.score, r.spans) for r in found[:3]] == [("und", 0.0, [])] * 3
    assert found[5].lang == "en" and len(found[5].spans) == 1  # a script of no language says nothing
    assert found[6].lang == "ru" and found[7].lang == "de" and found[9].lang == "de" and found[9].score == 1.0
    assert all(0 <= r.score <= 1 for r in found)


def test_scripts_narrow_the_candidates(model):
    latin, cyrillic = (language.SCRIPT_NAMES.index(s) + 1 for s in ("latin", "cyrillic"))
    assert dict(zip(model.languages, model.allowed[latin])) == {"en": True, "de": True, "ru": False}
    assert dict(zip(model.languages, model.allowed[cyrillic])) == {"en": False, "de": False, "ru": True}


def test_no_labels_and_empty_tables(spark, model):
    none = language.train(R.documents(spark, [ENGLISH, GERMAN]))
    assert [r.lang for r in labels(spark, none, [ENGLISH, "", None])] == ["und"] * 3
    assert labels(spark, model, []) == []
    assert language.accepted(R.documents(spark, []), model).collect() == []


def test_copies_are_one_text_of_the_sample(spark):
    """A text that fills most of a language's rows counts once, and the sample's bound is in distinct texts."""
    texts = [GERMAN * 3] * 400 + [f"{ENGLISH}{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    langs = {i: "de" if i < 400 else "en" for i in range(500)}
    few = language.train(R.documents(spark, texts, langs=langs), per_language=10)
    assert few.languages == ["de", "en"]
    once = language.train(R.documents(spark, [GERMAN * 3], langs={0: "de"}))
    np.testing.assert_allclose(few.scores[:, 0], once.scores[:, 0], rtol=1e-6)
    assert (few.scores[:, 1] > few.scores[:, 1].min()).sum() < (language.train(R.documents(spark, texts, langs=langs)).scores[:, 1] > few.scores[:, 1].min()).sum() + language.BUCKETS


def test_accepted_keeps_columns_and_repeated_rows(spark, model):
    docs = R.clashing(R.documents(spark, [ENGLISH, ENGLISH, "12", None, GERMAN], ids=[1, 1, 2, 3, None]))
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]
    assert [r.doc_id for r in language.accepted(docs, model, languages=["de"]).collect()] == [None]


def all_paths(scores, penalty):
    ways = itertools.product(range(scores.shape[1]), repeat=len(scores))
    return max(sum(scores[i, s] for i, s in enumerate(w)) - penalty * sum(a != b for a, b in zip(w, w[1:])) for w in ways)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    lengths = [3, 0, 1, 6, 2, 0]
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(size=(first[-1], 3)).astype(np.float32) * 2
    path = language.viterbi(scores, first, 1.5)
    for a, b in zip(first, first[1:]):
        if b > a:
            own = path[a:b]
            value = sum(scores[a + i, s] for i, s in enumerate(own)) - 1.5 * int((np.diff(own) != 0).sum())
            assert value == pytest.approx(all_paths(scores[a:b], 1.5), abs=1e-4)


def test_paths_do_not_depend_on_groups(spark, model):
    texts = [ENGLISH, GERMAN * 4, "", ENGLISH + GERMAN] * 5
    together = list(model.label(iter([texts])))
    assert together == list(model.label(iter([[t] for t in texts])))


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = book.op5_language_spans(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(rows)
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) / len(held) > 0.97
