import hashlib
import zlib

import numpy as np
import pytest

import rows as R
from chartspark.llm import book, token_files
from hypothesis import given, settings
from hypothesis import strategies as st


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(book.tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return token_files.Encoder(book.tokenizer_path())


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("bits,planes", [(8, 4), (1, 32)])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 65536, 1003])
def test_planes_round_trip(bits, planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    packed = token_files.to_planes(ids, bits)
    assert len(packed) == planes and (token_files.from_planes(packed, n, bits) == ids).all()


@given(st.binary(), st.binary())
def test_joined_checksums(a, b):
    assert token_files.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


AWKWARD = [
    "", " ", "  two", "a  b", "a b ", " a", "tab\tand\nline\n next", "it's 5 o'clock, isn't it?", "<|endoftext|> x", "see <|endoftext|> here", "a<|endoftext|>b <|endoftext|>c d<|endoftext|> <|endoftext|><|endoftext|> e", "<|endoftext|>", " <|endoftext|>", "<|endoftext", "Ġ Ġa", "漢字 한국 ñ é", "a\u00a0b c", "a \u200bb", "x \u3000 y", "\r\n \r\n", "'s 's", "end.", "a \ufeff b", "ʼn 1 ２",
]


def test_cut_encoding_equals_whole_encoding(encoder, plain):
    for text in AWKWARD:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids_of(plain, text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "word", "The", "'s", "12", "é", "漢", ".", "\t", "\u00a0", "!?", "\U0001f600", "<|endoftext|>", "<|end", "oftext|>"])).map("".join))
def test_cut_encoding_on_random_texts(encoder, plain, text):
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids_of(plain, text)


def test_long_texts_are_cut_into_segments(encoder, plain, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_CHARS", 50)
    text = " ".join(f"word{i}, it's" + ("\n" if i % 9 == 0 else "") for i in range(200))
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids_of(plain, text)


def test_special_tokens_are_those_of_the_library(encoder):
    assert np.frombuffer(encoder.encode(["see <|endoftext|> here"])[0], "<u4").tolist() == [3826, 220, 50256, 994]


def expected(plain, rows, end=0):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())):
        ids = np.array([*ids_of(plain, text), end], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def read(spark, folder):
    return [tuple(r) for r in token_files.read_documents(spark, folder).orderBy("start").collect()]


@pytest.mark.parametrize("bits", [8, 1])
def test_files_read_back(spark, plain, tmp_path, bits):
    texts = [None, "", "some words here", "long text " * 500, *AWKWARD, "x"]
    docs = R.clashing(R.documents(spark, texts))
    folder = token_files.write(docs, book.tokenizer_path(), str(tmp_path / "t"), block_ids=64, plane_bits=bits, shards=3)
    assert read(spark, folder) == expected(plain, enumerate(texts))
    blocks = token_files.read_ids(spark, folder).orderBy("shard", "chunk").collect()
    assert all(len(b.ids) <= 64 for b in blocks)
    assert [i for b in blocks for i in b.ids] == [i for t in texts for i in [*ids_of(plain, t), 0]]


def test_repeated_and_null_ids_and_empty_table(spark, plain, tmp_path):
    rows = [(3, "a"), (3, "a"), (3, "b c"), (None, "z"), (None, None), (1, "q")]
    docs = R.documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    assert read(spark, token_files.write(docs, book.tokenizer_path(), str(tmp_path / "a"), shards=2)) == expected(plain, rows)
    assert read(spark, token_files.write(docs.limit(0), book.tokenizer_path(), str(tmp_path / "b"))) == []


def test_query_against_whole_encoding(spark, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{R.SF}/documents.parquet").collect()]
    assert [tuple(r) for r in book.op10_token_planes(spark, R.SF).orderBy("start").collect()] == expected(plain, rows)
