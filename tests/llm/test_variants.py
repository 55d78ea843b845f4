"""Spelling variants against a brute-force version."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from pitchlake.llm import variants
from pitchlake.llm.queries import op12_asymmetric_chunks


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def told(counts: dict[str, int]) -> list[tuple]:
    near = {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def counted(rows: list[tuple[int | None, str | None]]) -> dict[str, int]:
    found: Counter[str] = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if doc is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def edited(r: random.Random, w: str, letters: str) -> str:
    k, c = r.randrange(len(w) + 1), r.choice(letters)
    return r.choice((w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]))


@pytest.mark.parametrize("group", [2, 8, 256])
def test_all_near_words_are_found(spark, group):
    """Few letters, so that all keys are hot at small groups; repeated letters, words that start or end alike."""
    r = random.Random(7)
    found = {"".join(r.choice("ab") for _ in range(r.randrange(7, 11))) for _ in range(150)}
    found |= {"interna" + "".join(r.choice("xyzÿ") for _ in range(3)) for _ in range(60)} | {"".join(r.choice("xyzÿ") for _ in range(3)) + "tionale" for _ in range(60)}
    base = ["straßenbahn", "Éclairage"[1:] + "É", "aaaaaaaa", "letters" * 9]
    found |= {x for b in base for _ in range(25) for x in (b, edited(r, b, "aeÿz")) if len(x) >= 7}
    counts = {w: r.choice((2, 3, 20, 30, 400, 5000)) for w in found}
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3)
    assert sorted(map(tuple, variants.variants(df, group=group).collect())) == told(counts)


def test_chains_are_followed_to_the_last(spark):
    words = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb"]
    counts = {w: 2 * 10**k for k, w in enumerate(words)}
    got = {x["word"]: x["root"] for x in variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == {w: words[-1] for w in words}


def test_rows(spark, tmp_path):
    """Null, empty and long texts, repeated rows, no id, capitals, other letters, a column that clashes, an empty table."""
    r = random.Random(3)
    lexicon = ["".join(r.choice("abcdeèÀÿ") for _ in range(r.randrange(5, 13))) for _ in range(60)]
    lexicon += [edited(r, w, "abcdeß") for w in lexicon]
    rows = [(k, "-".join(w.upper() if r.random() < 0.2 else w for w in (r.choice(lexicon[: r.choice((5, 30, 120))]) for _ in range(r.randrange(120))))) for k in range(150)]
    rows += [(9, None), (10, ""), (None, " ".join(lexicon * 2)), rows[3], rows[3], (12, "z" * 50_000 + " " + "z" * 50_000), (13, "wordofmine " * 5000)]
    folder = str(tmp_path)
    spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, word string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    out = op12_asymmetric_chunks(spark, folder)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = told(counted(rows))
    assert sorted(map(tuple, out.collect())) == want
    assert sum(x[1] is not None for x in want) > 20
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{folder}/none/documents.parquet")
    assert op12_asymmetric_chunks(spark, f"{folder}/none").count() == 0
