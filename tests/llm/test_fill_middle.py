import hashlib
import re

import pytest
import rows as R
from pyspark.sql import functions as F

from chartspark.llm import book, fill_middle

WORDS = tuple(s.encode() for s in fill_middle.SENTINELS)


def brute(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by ordinary code."""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(s in text for s in fill_middle.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


LONG = "Wörter and words, " * 200_000
TEXTS = ["", None, "x", "a" * 3_000_000, LONG, "<", "<P", "P>S>M>", "has <S> in it", "é漢\n\n 12", "<<<P>", "a<", "ab cd", "ab cd", "\x00 \x7f", "M> <P <S tail <", "İß ſ"]


def test_against_ordinary_code(spark):
    ids = [*range(len(TEXTS)), *range(100, 100 + 12 * len(TEXTS)), None]
    texts = [*TEXTS, *(t if t is None or len(t) < 1000 else t[:1000] for t in TEXTS for _ in range(12)), "no id"]
    docs = R.clashing(R.documents(spark, texts, ids=ids))
    made = fill_middle.samples(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).withColumn("back_sha256", fill_middle.restored_sha256(F.col("output"), F.col("form")))
    found = {r.doc_id: r for r in made.collect()}
    assert len(found) == len(ids) and {r.form for r in found.values()} == {"plain", "psm", "spm"}
    for doc_id, text in zip(ids, texts):
        r, text = found[doc_id], text or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(doc_id, text), doc_id
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.back == text and r.back_sha256 == hashlib.sha256(text.encode()).hexdigest()
        buffers = [text.encode(), *WORDS]
        assert b"".join(buffers[p.buffer][p.start : p.end] for p in r.pieces) == r.output.encode()


def test_table_operations():
    table = fill_middle.PieceTable.of(b"abcdef", WORDS)
    parts = table.cut(2, 4)
    assert [p[1:] for p in parts.pieces] == [(0, 2), (2, 4), (4, 6)] and parts.bytes() == b"abcdef"
    assert parts.arranged("psm").bytes() == b"<P>ab<S>ef<M>cd" and parts.arranged("spm").bytes() == b"<S>ef<P>ab<M>cd"
    for form in fill_middle.FORMS:
        assert parts.arranged(form).restored(form).pieces == parts.pieces
    assert table.cut(0, 0).bytes() == table.cut(6, 6).bytes() == table.cut(6, 0).bytes() == b"abcdef"
    assert parts.arranged("psm").cut(1, 4, 9).bytes() == b"<P>ab<S>ef<M>cd"  # descriptors of every buffer can be cut
    with pytest.raises(ValueError):
        fill_middle.parsed(b"ab<P>", "psm", WORDS)


def test_repeated_rows_and_empty_table(spark):
    docs = R.documents(spark, ["one two", "one two"], ids=[7, 7])
    assert len(set(fill_middle.samples(docs).select("output", "form").collect())) == 1
    assert fill_middle.samples(docs.limit(0)).collect() == []


def test_own_sentinels(spark):
    docs = R.documents(spark, ["one two three " * 5] * 40)
    own = ("<|pre|>", "<|suf|>", "<|mid|>")
    made = fill_middle.samples(docs, sentinels=own).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), own))
    assert all(r.back == "one two three " * 5 for r in made.collect())


def test_query_has_a_row_a_document(spark):
    assert book.op12_piece_table_fim(spark, R.SF).count() == spark.read.parquet(f"{R.SF}/documents.parquet").count()
