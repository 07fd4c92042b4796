"""Coding by distinct words against the tokenizer library, and its results at the edges."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from clientela.llm import word_coding
from clientela.llm.text_queries import RANKS

SCHEMA = "doc_id long, text string, chunk long, bucket int, ids string, token string"
EXTRA = (1, 2, "x", "y")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def strange_texts(n, seed):
    rng = random.Random(seed)
    letters = "ab e'st'll 12\t\n\r\xa0 　\x85é中😀½ﬁ<|>#_-"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("chunk_bytes", [word_coding.CHUNK_BYTES, 200])
def test_ids_as_by_the_library_and_back(spark, library, chunk_bytes):
    texts = strange_texts(300, 1) + ["", None, "a" * 20_000, " the" * 5000, "<|endoftext|>", " " * 999]
    texts += ["the same text"] * 50
    rows = [(i, t, *EXTRA) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = word_coding.encode(df, RANKS, chunk_bytes=chunk_bytes).collect()
    assert len(found) == len(texts)
    for row in found:
        text = texts[row["doc_id"]] or ""
        ids = np.frombuffer(bytes(row["ids"]), dtype="<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()


def test_documents_at_the_edges(spark):
    assert word_coding.encode(spark.createDataFrame([], SCHEMA), RANKS).collect() == []
    rows = [(None, "a b", *EXTRA), (None, None, *EXTRA), (4, "a b", *EXTRA), (4, "a b", *EXTRA)]
    found = word_coding.encode(spark.createDataFrame(rows, SCHEMA), RANKS).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"])) for r in found) == [
        (0, b""), (0, b"a b"), (4, b"a b"), (4, b"a b")
    ]
    only_empty = word_coding.encode(spark.createDataFrame([(1, "", *EXTRA)], SCHEMA), RANKS)
    assert [(r["doc_id"], bytes(r["ids"])) for r in only_empty.collect()] == [(1, b"")]
    named = spark.createDataFrame([("k", "x y")], "doc_id string, text string")
    assert [r["doc_id"] for r in word_coding.encode(named, RANKS).collect()] == ["k"]


def test_ids_are_decoded_by_the_token_table(spark, library):
    texts = strange_texts(40, 2) + ["", "a b c"]
    rows = [(i, library.encode_ordinary(t)) for i, t in enumerate(texts)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    found = {r["doc_id"]: bytes(r["decoded"]) for r in word_coding.decode(df, RANKS).collect()}
    assert found == {i: t.encode() for i, t in enumerate(texts)} | {99: b""}


def test_merges_as_by_the_library(library):
    ranks = word_coding.ranks_of(open(RANKS, "rb").read())
    rng = random.Random(5)
    words = [bytes(rng.choice(b"aabcest ing\xc3\xa9") for _ in range(rng.randint(1, 300))) for _ in range(500)]
    for word in [*words, b"a" * 5000, b"ab" * 3000]:
        assert word_coding.merged(word, ranks) == library._encode_single_piece(word)


def test_all_letters_split_alike(library):
    for start in range(0, 0x30000, 64):
        text = "".join(f"{chr(c)}a1{chr(c)} " for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        ranks = library._mergeable_ranks
        ids = [i for w in word_coding.split(text) for i in word_coding.merged(w.encode(), ranks)]
        assert ids == library.encode_ordinary(text), hex(start)


def test_numbers_and_strings_are_packed_whole():
    for numbers in ([], [0], [1, 2**32 - 1, 70_000, 0]):
        assert word_coding.unpacked_numbers(word_coding.packed_numbers(numbers)).tolist() == numbers
    for strings in ([], [b""], [b"a", b"", b"\x00" * 300]):
        assert word_coding.unpacked_strings(word_coding.packed_strings(strings)) == strings


def test_a_chunk_without_a_reply_fails(spark):
    import pandas as pd

    chunk = word_coding._chunk(0, [1], [1], [np.zeros(1, "<u4")], word_coding.Dictionary(a=0), 8)
    replies = pd.DataFrame({"replies": [], "token": [], "bytes": []})
    with pytest.raises(RuntimeError):
        word_coding._reassembled(chunk, replies)
