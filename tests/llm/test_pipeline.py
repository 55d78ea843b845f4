"""Each stage of the pipeline against a brute-force version on its own input."""

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from pitchlake.llm import bpe, toxicity
from pitchlake.llm.common import stored

from .test_classifiers import brute_score
from .test_decontam import brute as brute_contamination
from .test_linededup import brute as brute_lines
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input of each stage, and the result."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        out.append(docs)
        docs = stored(stage(spark, docs, SF), name.replace(" ", "-"))
    return [*out, docs]


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_all_but_the_last_keep_the_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[1:-1]) and [len(P.STAGES), len({n for n, _ in P.STAGES})] == [5, 5]


def test_toxicity(spark, stages):
    lexicon = toxicity.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    before = texts(stages[0])
    assert texts(stages[1]) == {i: t for i, t in before.items() if brute_score(lexicon, t) < P.TOXIC}


def test_line_dedup(stages):
    before = texts(stages[1])
    assert texts(stages[2]) == brute_lines(sorted(before.items())) != before


def test_near_duplicates(stages):
    before = texts(stages[2])
    classes = brute_components({i: brute_fingerprint(t) for i, t in before.items()})
    assert texts(stages[3]) == {i: t for i, t in before.items() if classes[i] == i}


def test_decontamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, n, h, _ in brute_contamination(list(texts(stages[3]).items()), items) if h > 0 and 20 * h >= n}
    assert texts(stages[4]) == {i: t for i, t in texts(stages[3]).items() if i not in bad}


def test_encoding(stages):
    ranks = bpe.Vocabulary(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: list(r.ids) for r in stages[5].collect()} == {i: library.encode_ordinary(t) for i, t in texts(stages[4]).items()}


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (2, "", None, None, 0), (3, "same words here again and again for all of us", "en", "s", 10), (4, "same words here again and again for all of us", "en", "s", 10), (None, "no id", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for x in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            x = stored(stage(spark, x, SF), name.replace(" ", "-"))
        assert x.count() <= 4


def test_decisions_are_about_rows(spark):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(2).collect()]
    clean = [f"a clean text of some words with the number {w}" for w in ("one", "two of them", "three and so on", "four to end with")]
    row = lambda i, t: (i, t, "en", "s", len(t))
    docs = spark.createDataFrame([row(5, items[0]), row(5, clean[0]), row(None, items[1]), row(None, clean[1])], columns)
    assert {r.text for r in P.contaminated_documents_go(spark, docs, SF).collect()} == set(clean[:2])
    docs = spark.createDataFrame([row(7, clean[2]), row(7, clean[2]), row(7, items[0]), row(None, items[1]), row(None, items[1]), row(9, clean[2])], columns)
    assert sorted((str(r.doc_id), r.text) for r in P.near_duplicates_go(spark, docs, SF).collect()) == sorted([("7", clean[2]), ("7", items[0]), ("None", items[1])])
    large = "/root/testdata/sf0.01"
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{large}/documents.parquet").collect()}
    lexicon = toxicity.fit(spark.read.parquet(f"{large}/documents.parquet"), spark.read.parquet(f"{large}/labels.parquet"))
    bad = max(before.values(), key=lambda t: brute_score(lexicon, t))
    docs = spark.createDataFrame([*(row(i, t) for i, t in before.items()), row(10_000, bad), row(10_000, clean[3]), row(None, bad)], columns)
    after = [(r.doc_id, r.text) for r in P.toxic_documents_go(spark, docs, large).collect()]
    assert (10_000, clean[3]) in after and (10_000, bad) not in after and (None, bad) not in after


def test_clashing_columns(spark):
    """Columns with the names that the stages use, at all stages."""
    names = ["__tie", "_id", "_tie", "row", "text_", "key", "tie", "id", "gone", "first", "score", "n_hit", "fp", "ids", "a.b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    plain, wide = docs, docs.select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names))
    wide, plain = stored(wide, "wide"), stored(plain, "plain")
    for name, stage in P.STAGES[:-1]:
        plain, wide = (stored(stage(spark, x, SF), f"{name.replace(' ', '-')}-{k}") for k, x in enumerate((plain, wide)))
        assert wide.columns == [*docs.columns, *names]
        assert texts(wide) == texts(plain) != {}
        assert all(r[n] == f"{n} {r.doc_id}" for r in wide.collect() for n in names)
    last = [{r.doc_id: list(r.ids) for r in P.encoded(spark, x, SF).collect()} for x in (plain, wide)]
    assert last[0] == last[1]
