import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pitchlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def words():
    return bpe.Vocabulary(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library(words):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})


def ids(words, texts):
    data = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    flat, ends = words.encode(b"".join(data), at)
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_random_texts_as_the_library(words, library):
    rng = random.Random(3)
    parts = ["'", "s", "t", "re", "ll", "ve", "d", " ", "\n", "\t", "a", "é", "5", "½", "!", " ", " ", "😀", "中", "\x1c", "'s", "  ", " '"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    assert ids(words, texts) == [library.encode_ordinary(t) for t in texts]


def test_scan_is_the_sequential_product():
    symbols, product, _, _ = bpe.automaton()
    f = symbols[np.random.default_rng(1).integers(0, 16, 1001)]
    expected, x = [], None
    for y in f.tolist():
        x = y if x is None else int(product[x, y])
        expected.append(x)
    assert bpe.compose_scan(f, product).tolist() == expected


def test_long_words_merge_as_the_library(words, library):
    for text in ("a" * 3000, "abcab" * 200, "é" * 500):
        assert bpe.merge(text.encode(), words.ranks) == library.encode_ordinary(text)


def test_frames_round_trip_with_odd_rows(spark, words, library):
    rows = [(1, "Don't stop", "x"), (2, None, "y"), (2, None, "y"), (3, "", "z"), (4, "word " * 50_000, "z"), (None, " é\n\n b", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(map(str, got)) == sorted(map(str, bpe.round_trip(docs, PATH).collect())) and bpe.round_trip(docs.limit(0), PATH).count() == 0
    assert sorted((r.doc_id or -1, hashlib.md5(bytes(r.text)).hexdigest(), len(r.ids)) for r in got) == sorted((i or -1, hashlib.md5((t or "").encode()).hexdigest(), len(library.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0


def test_foreign_offsets_are_refused(spark):
    wrong = spark.createDataFrame([(1, [5, 6], [0, 7])], "doc_id bigint, ids array<int>, offsets array<int>")
    with pytest.raises(Exception, match="don't belong"):
        bpe.decode(wrong, PATH).collect()


def test_query_over_a_whole_table(spark, library):
    from pitchlake.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op2_byte_bpe(spark, sf).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {i: (len(e := library.encode_ordinary(t)), sha(" ".join(map(str, e)).encode()), sha(t.encode())) for i, t in texts.items()}


def test_every_code_point_as_the_library(words, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)} {chr(c)}1" for c in points[k : k + 2048]) for k in range(0, len(points), 2048)]
    for k in range(0, len(texts), 20):
        assert ids(words, texts[k : k + 20]) == [library.encode_ordinary(t) for t in texts[k : k + 20]]
