import math
import unicodedata
import zlib
from collections import Counter

import numpy as np

from pitchlake.llm import labelled, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def held(spark, query, label):
    rows = queries.queries()[query](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").select("doc_id", "held_out", "score", "predicted", label).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    return [r for r in rows if r.held_out and r[label] is not None], rows


def test_toxicity_on_held_out_rows(spark):
    known, every = held(spark, "op7_toxicity", "toxic")
    assert len(every) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert np.mean([r.predicted == r.toxic for r in known]) > 0.93
    assert sum(r.predicted > r.toxic for r in known) <= 1
    assert all(r.predicted == (r.score >= 0.7) for r in every)


def test_quality_on_held_out_rows(spark):
    known, _ = held(spark, "op9_quality", "quality")
    assert np.mean([r.predicted == r.quality for r in known]) > 0.95


def folded_words(text):
    """Words of a text by one character after the other."""
    out = [""]
    for c in unicodedata.normalize("NFC", text):
        kind = unicodedata.category(c)
        if kind[0] == "M" or kind == "Cf":
            continue
        if 0xFF21 <= ord(c) <= 0xFF3A or 0xFF41 <= ord(c) <= 0xFF5A:
            c = chr(ord(c) - 0xFEE0).lower()
        elif c in "lL":
            c = "i"
        elif c.lower() in toxicity.LOOKS or c in toxicity.LOOKS:
            c = toxicity.LOOKS.get(c) or toxicity.LOOKS[c.lower()]
        elif kind[0] == "L":
            c = c.lower() if len(c.lower()) == 1 else c
        else:
            c = " "
        if c == " ":
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def brute_features(lexicon, text):
    words = folded_words(text)
    safe = set()
    for phrase in map(folded_words, lexicon.exceptions):
        for k in range(len(words) - len(phrase) + 1):
            if words[k : k + len(phrase)] == phrase:
                safe |= set(range(k, k + len(phrase)))
    total = 0.0
    for k, w in enumerate(words):
        starts = [f" {w} ", *(f" {w[:n]}" for n in range(len(w), 0, -1))]
        entry = next((e for e in starts if e in lexicon.weights), None)
        if entry and k not in safe:
            total += lexicon.weights[entry]
    return total / (len(words) + 20), math.log1p(total)


def brute_score(lexicon, text):
    d, s = brute_features(lexicon, text)
    a, b, c = lexicon.curve
    return 1 / (1 + math.exp(-(a + b * d + c * s)))


def test_toxicity_against_one_word_after_the_other(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert got.keys() == texts.keys() and all(abs(got[i] - brute_score(lexicon, t)) < 1e-9 for i, t in texts.items())
    # the entries, their weights and the exception phrases, from all labelled rows that aren't held out
    known = [(texts[r.doc_id], r.toxic) for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    counts, size = (Counter(), Counter()), Counter(y for _, y in known)
    for t, y in known:
        own = set()
        for w in folded_words(t):
            own |= {f" {w} ", *(f" {w[:n]}" for n in range(4, 9) if n <= len(w))}
        counts[y].update(own)
    weights = {}
    for e, n in counts[1].items():
        a, b = n + 0.5, counts[0][e] + 0.5
        w = math.log(a / (size[1] + 1)) - math.log(b / (size[0] + 1))
        if n >= 3 and w - 2.58 * math.sqrt(1 / a + 1 / b) > 1:
            weights[e] = w
    assert weights.keys() == lexicon.weights.keys() and all(abs(weights[e] - w) < 1e-9 for e, w in lexicon.weights.items()) and weights
    pairs = (Counter(), Counter())
    for t, y in known:
        words = folded_words(t)
        hit = [f" {w} " in weights or any(f" {w[:n]}" in weights for n in range(1, len(w) + 1)) for w in words]
        pairs[y].update({f"{words[k]} {words[k + 1]}" for k in range(len(words) - 1) if hit[k] or hit[k + 1]})
    assert set(lexicon.exceptions) == {p for p, n in pairs[0].items() if n >= 3 and not pairs[1][p]}


def test_exception_phrases_are_learned(spark):
    clean = [f"put it in the trash can over there number {i}" for i in range(300, 340)]
    toxic = [f"you trash person with {w} words" for w in ("few", "many", "some", "no", "old", "new") for _ in range(8)]
    rows = list(enumerate([*clean, *toxic], 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(t.startswith("you"))) for i, t in rows], "doc_id bigint, toxic int")
    lexicon = toxicity.fit(docs, labels)
    lexicon.weights[" trash "] = 3.0
    assert brute_features(lexicon, "the trash person")[1] > 0
    lexicon.exceptions = ("trash can",)
    found = lexicon.automaton()
    assert lexicon.features(found, "a trash can")[1] == 0 < lexicon.features(found, "a trash candle")[1]
    assert lexicon.phrases(found, "A trash can. Trash!") == {"a trash", "trash can", "can trash"}


def test_folding():
    lexicon = toxicity.Lexicon({" idiot": 5.0, " idio": 3.0, " trash ": 4.0}, ("trash can",), (-4.0, 10.0, 2.0))
    found = lexicon.automaton()
    total = lambda t: round(np.expm1(lexicon.features(found, t)[1]), 6)
    for t in ("You idiot", "1d10t!", "ІDІОT", "ｉｄｉｏｔ", "i\u200bdiot", "idi\u0336ot"):
        assert total(t) == 5.0, t
    assert total("trash, trashy and an idio") == 7.0
    assert total("a trash can") == 0.0
    assert total("") == total("video") == 0.0


def test_the_sample_keeps_its_bound(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(500)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(5)] * 3, "doc_id bigint, toxic int")
    for most in (1, 2, 100):
        assert labelled.sample(docs, labels, "toxic", most).count() == min(most, sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(5)))
    assert labelled.sample(docs, labels, "toxic", 2).collect() == labelled.sample(docs.repartition(7), labels, "toxic", 2).collect()


def brute_statistics(text):
    words, lines, n = text.split(), text.split("\n"), len(text)
    if not words:
        return [0.0] * 24
    w, white = len(words), " \t\n\v\f\r"
    share = lambda chars: sum(c in chars for c in text) / n
    points = Counter(min(ord(c), 255) for c in text)
    per_line = [len(x.split()) for x in lines]
    mean = sum(map(len, words)) / w
    return [
        math.log(n + 1), math.log(w + 1), mean, math.sqrt(sum((len(x) - mean) ** 2 for x in words) / w), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"),
        share(".,;:!?'\"()-"), share("#*%&$^~<>{}[]\\=+_@"), share(white), math.log(len(lines) + 1), w / len(lines), sum(k < 3 for k in per_line) / len(lines),
        1 - len(set(lines)) / len(lines), len(set(words)) / w, max(Counter(words).values()) / w, sum(words[k] == words[k + 1] for k in range(w - 1)) / w,
        len({(words[k], words[k + 1]) for k in range(w - 1)}) / max(1, w - 1), sum(x.lower() in quality.COMMON for x in words) / w,
        sum(len(x) > 1 and x.isupper() for x in words) / w, sum(x.rstrip()[-1:] in ".!?" for x in lines if x) / len(lines),
        -sum(v / n * math.log2(v / n) for v in points.values()), math.log(max(map(len, words)) + 1), text.count("!") / w, text.count("|") / w,
    ]


def test_statistics_and_scores_of_quality_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for t in ["", " \n ", "a", "A! a|b\n\nA! 😀 ünï", *texts.values()]:
        assert np.allclose(quality.statistics(t), brute_statistics(t)), t[:80]
    forest = quality.fit(docs, labels)

    def walk(row):
        total = forest.start
        for t in range(len(forest.feature)):
            i = 0
            while i < forest.feature.shape[1]:
                i = 2 * i + (2 if row[forest.feature[t, i]] > forest.threshold[t, i] else 1)
            total += forest.value[t, i - forest.feature.shape[1]]
        return 1 / (1 + math.exp(-total))

    got = {r.doc_id: r.score for r in quality.score(docs, forest).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts)[:150]:
        assert abs(got[i] - walk(quality.statistics(texts[i]))) < 1e-9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "word " * 90_000, 1.0), (3, "word " * 90_000, 1.0), (None, "x\n\n|", 1.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for module, default in ((toxicity, 0.0), (quality, 0.5)):
        model = module.fit(docs, labels.limit(0))
        got = module.score(docs, model).collect()
        assert len(got) == 5 and {r.score for r in got} == {default}
        assert module.score(docs.limit(0), module.fit(docs, labels)).count() == 0
        assert all(0 <= r.score <= 1 for r in module.score(docs, module.fit(docs, labels)).collect())


def test_forest_equals_walking_its_trees():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    f = quality.grow(x, y, trees=25)

    def walk(row):
        total = f.start
        for t in range(len(f.feature)):
            i = 0
            while i < f.feature.shape[1]:
                i = 2 * i + (2 if row[f.feature[t, i]] > f.threshold[t, i] else 1)
            total += f.value[t, i - f.feature.shape[1]]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(f.score(x[:50]), [walk(r) for r in x[:50]])
    assert ((f.score(x) >= 0.5) == y).mean() > 0.95
