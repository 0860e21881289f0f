"""Byte-level BPE against the tiktoken library, and as an exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.llm import bpe
from tallymark.llm.queries import QUERIES

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TOKENS = bpe.tokens_of(RANKS)
PATTERN = public_tokenizers.PATTERN
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=TOKENS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS)


def ids_of(codec, texts):
    return [np.frombuffer(b, "<i4").tolist() for b in codec.encode(texts, regex.compile(PATTERN))]


def test_whole_query_against_the_library(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = LIBRARY.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_odd_documents(spark, odd, none):
    made = bpe.encode_texts(odd, RANKS, PATTERN, decoded=True)
    assert made.columns == ["doc_id", "ids", "decoded"]
    rows = made.collect()
    given_texts = [r.text or "" for r in odd.select("text").collect()]
    assert sorted(bytes(r.decoded) for r in rows) == sorted(t.encode() for t in given_texts)
    assert sorted(map(tuple, (r.ids for r in rows))) == sorted(
        tuple(LIBRARY.encode_ordinary(t)) for t in given_texts
    )
    assert bpe.encode_texts(none, RANKS, PATTERN).count() == 0
    empty = bpe.digests(made).where("n_tokens = 0").select("ids_sha256", "decoded_sha256").distinct().collect()
    assert {h for r in empty for h in r} == {hashlib.sha256(b"").hexdigest()}


def test_string_ids_and_decoding_alone(spark):
    docs = spark.createDataFrame([("a", "hello world"), ("b", None), (None, " x")], "doc_id string, text string")
    rows = bpe.encode_texts(docs, RANKS, PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode_ids(rows, RANKS).collect()} == {
        "a": b"hello world", "b": b"", None: b" x",
    }
    odd_ids = spark.createDataFrame([(1, None), (2, []), (3, [15496, None]), (4, [999999]), (5, [15496])],
                                    "doc_id int, ids array<int>")
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in bpe.decode_ids(odd_ids, RANKS).collect()} == {
        1: None, 2: b"", 3: None, 4: None, 5: b"Hello",
    }


def test_long_words_ties_and_overlapping_pairs(codec):
    draw = random.Random(5)
    words = ["a" * n for n in range(1, 40)] + ["a" * 5001, " " * 3000, "ab" * 1000 + "ba" * 500, "漢字" * 400]
    words += ["".join(draw.choice("ACGT") for _ in range(4000)), "aab" * 700, "\u0000" * 50, "\U0001f600" * 99]
    assert ids_of(codec, words) == [LIBRARY.encode_ordinary(w) for w in words]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(texts):
    codec = bpe.codec(RANKS)
    found = ids_of(codec, texts)
    assert found == [LIBRARY.encode_ordinary(t) for t in texts]
    assert codec.decode([np.array(i, dtype=np.int32) for i in found]) == [t.encode() for t in texts]


def test_every_character_splits_as_in_the_library(codec):
    chars = [chr(c) for c in range(0, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}{c} {c}." for c in chars[i : i + 64]) for i in range(0, len(chars), 64)]
    assert ids_of(codec, texts) == LIBRARY.encode_ordinary_batch(texts)


def test_no_merge_makes_a_lower_rank():
    assert bpe.out_of_order(TOKENS) == []


def test_forgotten_words_change_nothing(codec, monkeypatch):
    texts = ["one two three four five six", "seven eight one two", "nine"]
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 10)
    monkeypatch.setattr(bpe, "WORD_BYTES", 7)
    assert ids_of(codec, texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_refuses_a_large_or_broken_rank_file(tmp_path, monkeypatch):
    path = tmp_path / "ranks"
    path.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="lacks"):
        bpe.tokens_of(bpe.read_ranks(str(path)))
    monkeypatch.setattr(bpe, "MAX_RANK_BYTES", 3)
    with pytest.raises(ValueError, match="travel"):
        bpe.read_ranks(str(path))


def test_hot_text_over_many_partitions(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("same words again").alias("text"))
    rows = bpe.encode_texts(docs.repartition(7), RANKS, PATTERN).select("ids").distinct().collect()
    assert [list(r.ids) for r in rows] == [LIBRARY.encode_ordinary("same words again")]
