from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pitchlake.llm import bpe, queries, tokenfiles
from pitchlake.llm.common import shared_path

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary(open(PATH, "rb").read()).ranks, special_tokens={})


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    expected = Counter(len(library.encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = queries.op5_separator_scan(spark, sf).collect()
    assert Counter(r.n_tokens for r in rows) == expected and all(r.ended for r in rows)


def test_blocks_are_stitched(spark, library):
    texts = ["", "one two", None, "a b c d e f g " * 30, "", "", "x"]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "f", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, file string, size int").coalesce(1)
    path = shared_path(spark, "tokens")
    tokenfiles.write(docs, path, PATH)
    sizes = [len(library.encode_ordinary(t or "")) for t in texts]
    starts = (np.cumsum(sizes) + np.arange(len(sizes)) - sizes).tolist()
    for block in (1, 2, 7, 64, 1 << 20):
        rows = sorted(tokenfiles.count(spark, path, block).collect(), key=lambda r: r.document)
        assert [(r.document, r.first_token, r.n_tokens, r.ended) for r in rows] == [(i, s, n, True) for i, (s, n) in enumerate(zip(starts, sizes))]


def test_files_of_several_byte_ranges(spark, tmp_path):
    """Ranges and blocks that start at odd bytes, line feeds and zero bytes in tokens, and documents over several of them."""
    rng = np.random.default_rng(5)
    kinds = [0x0000, 0x0A00, 0x000A, 0x0A0A, 0x0100, 0x0001, 0x00FF, 0xFF00, 0x0D0A]
    files = {f"part-{k}": rng.choice(kinds, n, p=[0.2, *[0.1] * 8]).astype("<u2") for k, n in enumerate((3000, 1001, 7, 500))}
    files["part-long"] = np.concatenate([np.full(4000, 0x0A00), [0], np.full(3000, 0x0100), [0, 0, 0], np.full(999, 10)]).astype("<u2")
    for name, data in files.items():
        (tmp_path / name).write_bytes(data.tobytes())
    expected = []
    for name, data in files.items():
        ends, at = np.flatnonzero(data == 0).tolist(), 0
        for k, e in enumerate(ends):
            expected.append((name, k, at, e - at, True))
            at = e + 1
        expected += [(name, len(ends), at, len(data) - at, False)] * (at < len(data))
    most = "spark.sql.files.maxPartitionBytes"
    for size, block in (("128m", 1 << 20), ("1001b", 64), ("333b", 1 << 20), ("777b", 5)):
        old = spark.conf.get(most)
        spark.conf.set(most, size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            found = tokenfiles.zero_pairs(spark, f"file://{tmp_path}", block).select("file", "start").distinct().count()
            got = sorted(map(tuple, tokenfiles.count(spark, f"file://{tmp_path}", block).collect()))
        finally:
            spark.conf.set(most, old)
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == sorted(expected) and found > (20 if size != "128m" else 4)


def test_odd_files(spark, tmp_path):
    for name, data in (("part-a", b"\x05\x00\x06\x00\x00\x00\x07\x00"), ("part-b", b""), ("part-c", b"\x05\x00" * 9)):
        (tmp_path / name).write_bytes(data)
    for block in (1, 2, 100):
        rows = sorted((r.file, r.document, r.first_token, r.n_tokens, r.ended) for r in tokenfiles.count(spark, f"file://{tmp_path}", block).collect())
        assert rows == [("part-a", 0, 0, 2, True), ("part-a", 1, 3, 1, False), ("part-c", 0, 0, 9, False)]
    (tmp_path / "part-d").write_bytes(b"abc")
    with pytest.raises(Exception, match="odd number"):
        tokenfiles.count(spark, f"file://{tmp_path}").collect()


def test_many_files_and_empty_tables(spark):
    docs = spark.createDataFrame([(i % 3, "w " * i) for i in range(50)], "doc_id bigint, text string")
    path = shared_path(spark, "tokens")
    tokenfiles.write(docs, path, PATH, documents=4)
    assert tokenfiles.count(spark, path).count() == 50
    assert tokenfiles.written_and_counted(docs.limit(0), PATH).count() == 0
