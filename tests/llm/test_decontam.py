import hashlib
import random
import re
import time

import pytest

from pitchlake.llm import decontam, queries
from pitchlake.llm.common import stored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    """docs: (doc_id, text), items: (item_id, text); sorted rows of (doc_id, n_words, n_hit, items)."""
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    sizes, out = sorted({len(w) for w in windows}), []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = lambda t: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select({"documents": "doc_id", "benchmark": "item_id"}[t], "text").collect()]
    expected = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0 and 20 * h >= n) for d, n, h, i in brute(rows("documents"), rows("benchmark"))]
    assert sum(x[-1] for x in expected) > 0
    assert sorted(tuple(r) for r in queries.op6_inverted_index(spark, sf).collect()) == expected


def test_odd_rows_segments_and_blocks(spark):
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    docs = [(1, None), (2, ""), (3, "One, TWO three"), (3, "One, TWO three"), (4, long), (5, "x " * 40), (6, "zero one two three four. ünï one two"), (7, " ".join(f"w{i}" for i in range(900, 960)))]
    items = [(None, "null item words"), (10, "one two"), (10, "one two"), (2, "x x x x x x x x x x x x x x"), (30, None), (31, "!!"), (5, " ".join(f"w{i}" for i in range(910, 940))), (8, "ünï"), (40, " ".join(f"w{i}" for i in range(900, 960)))]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, n_words int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute(docs, items)
    for segment, block in ((decontam.SEGMENT, decontam.BLOCK), (50, 20)):
        index = stored(decontam.build_index(d, segment=segment), "index")
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(index, b, block=block).collect()) == expected
        assert decontam.contamination(index, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contamination(decontam.build_index(d.limit(0)), b).count() == 0


def test_phrases_and_proximity(spark):
    d = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "cat. Mat"), (3, "the mat the cat")], "doc_id bigint, text string")
    index = decontam.build_index(d)
    assert sorted(map(tuple, decontam.phrase_matches(index, ["The cat", "mat cat"]).collect())) == [("The cat", 1, 0), ("The cat", 3, 2)]
    assert {(r.phrase, r.doc_id) for r in decontam.proximity_matches(index, ["cat mat"], 2).collect()} == {("cat mat", 2), ("cat mat", 3)}


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_windows_of_few_words(spark, letters):
    """Windows that overlap, repeat and are of all lengths up to the longest."""
    r = random.Random(letters)
    text = lambda n: " ".join(r.choice("abcd"[:letters]) for _ in range(n))
    docs = [(k, text(r.randrange(60))) for k in range(60)]
    items = [(k, text(r.randrange(18))) for k in range(60)]
    index = stored(decontam.build_index(spark.createDataFrame(docs, "doc_id bigint, text string"), segment=100), "index")
    found = decontam.contamination(index, spark.createDataFrame(items, "item_id bigint, text string"), block=300)
    assert sorted((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in found.collect()) == brute(docs, items)


def test_many_items_against_a_segment_of_their_words(spark):
    """A block of 4 MB whose words are all in a segment, and a few windows of it that are there: well under a second for each MB."""
    r = random.Random(4)
    lexicon = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(3000)]
    weights = [1 / (k + 1) for k in range(len(lexicon))]
    items = [" ".join(r.choices(lexicon, weights, k=200)) for _ in range(4000)]
    text = r.choices(lexicon, weights, k=200_000)
    for k, item in zip(range(1000, 190_000, 20_000), items):
        text[k : k + 50] = item.split()[30:80]
    index = decontam.build_index(spark.createDataFrame([(1, " ".join(text))], "doc_id bigint, text string")).first()
    segment = decontam.Segment({c: index[c] for c in decontam.NAMES})
    blocks = decontam.item_blocks(spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()
    assert len(blocks) == 1
    block = decontam.Items([bytes(x) for x in blocks[0]["data"]], decontam.WINDOW)
    began = time.time()
    windows, found, size = block.found_in(segment)
    assert time.time() - began < 4
    assert len(block.item) > 700_000 and len(found) >= 10 * 38 and set(size.tolist()) == {13}
    assert all([segment.pairs()[0][p + o] for o in range(13)] == segment_words(segment, block, w) for w, p in zip(windows[:50].tolist(), found[:50].tolist()))


def segment_words(segment, block, window):
    names = list(block.terms)
    return [segment.terms[names[t]] for t in block.tokens[block.start[window] : block.end[window]].tolist()]
