import random
import re
import time
from functools import partial

import pytest

from pitchlake.llm import linededup

SCHEMA = "doc_id bigint, text string, n_chars bigint, line string, template string"


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA)
    return {r.doc_id: (r.text, r.n_chars, r.n_dropped, r.line) for r in linededup.drop_recurring_lines(docs, **options).collect()}


def row(i, text):
    return (i, text, None if text is None else len(text), "own", "col")


UNSPACED = re.compile("[㐀-鿿぀-ヿ฀-໿ក-៿က-႟]")


def form(line):
    """A line's form, for the characters that the tests use."""
    own = re.sub(r"[^\S\n]+", " ", line).strip(" ")
    if not re.search("[0-9]", own):
        return own
    some = re.sub("[0-9]+", "<*>", own) if UNSPACED.search(own) else " ".join("<*>" if re.search("[0-9]", x) else x for x in own.split(" "))
    return some if some.replace("<*>", "").strip(" ") else own


def brute(docs):
    """Lines that stay, by one line after the other: docs are (id, text) by ascending id, texts of an id are one document."""
    leaves, places = {}, {}
    for i, text in docs:
        for k, raw in enumerate(text.split("\n") if text is not None else ()):
            x = form(raw)
            if x:
                tokens = x.split(" ")
                known = leaves.setdefault((len(tokens), *(tokens[:3] if len(tokens) >= 5 else tokens)), [])
                template = next((t for t in known if sum(a == b for a, b in zip(t, tokens)) >= 0.8 * len(t) - 1e-9), None)
                if template is None:
                    known.append(template := tokens)
                places.setdefault(tuple(template), []).append((i, k))
    gone = {p for v in places.values() if len({i for i, _ in v}) > 1 for p in v[1:]}
    return {i: None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone) for i, text in docs}


def test_recurring_templates_stay_once(spark):
    a, b = "Page 17 of 44 was printed yesterday evening", "Page 3 of 9 was printed yesterday evening"
    got = run(spark, [row(1, f"One text that nobody else has got.\n{a}"), row(2, f"{b}\nAnother text that nobody else has got."), row(3, f"{a}\n{a}")])
    assert got == {1: (f"One text that nobody else has got.\n{a}", 34 + 1 + len(a), 0, "own"), 2: ("Another text that nobody else has got.", 38, 1, "own"), 3: ("", 0, 2, "own")}


def test_similar_lines_of_a_leaf_share_a_template(spark):
    base = "the quick brown fox jumps over the lazy dog today"
    other = base.replace("today", "again")
    far = "the quick brown cat sat on my old mat twice"
    got = run(spark, [row(1, base), row(2, other), row(3, far)])
    assert [got[i][0] for i in (1, 2, 3)] == [base, "", far]


def test_documents_and_tokens_can_be_asked_for(spark):
    short, long = "All rights reserved.", "a line of just some seven words"
    rows = [row(i, f"{short}\n{long}") for i in (4, 2, 9)]
    assert [x[0] for _, x in sorted(run(spark, rows).items())] == [f"{short}\n{long}", "", ""]
    assert [x[0] for _, x in sorted(run(spark, rows, min_tokens=5).items())] == [f"{short}\n{long}", short, short]
    assert all(x[2] == 0 for x in run(spark, rows, documents=4).values())
    assert sum(x[2] for x in run(spark, rows, documents=3).values()) == 4


def test_short_lines_recur_by_their_form(spark):
    short, passage = "All rights reserved.", "这是一个在许多文件中重复出现的很长的段落，没有空格。" * 5
    texts = [f"{short}\n\nown {i} text\n{passage}\n第{i}章很长\n{n}\n{n} {n}\n于{i}年{w}结束" for i, n, w in ((1, 11, "甲"), (2, 22, "乙"), (3, 33, "丙"))]
    got = run(spark, [row(i, t) for i, t in enumerate(texts, 1)])
    assert [got[i][0] for i in (1, 2, 3)] == [texts[0], "\n22\n22 22\n于2年乙结束", "\n33\n33 33\n于3年丙结束"]


def test_rows_of_numbers_are_not_taken_for_each_other(spark):
    tables = [f"{i} {i * 7} {i * 11} {i * 13} {i * 17} {i + 3}\nsum: {i} of all" for i in (1, 2, 3)]
    got = run(spark, [row(i, t) for i, t in enumerate(tables)])
    assert [got[i][0] for i in range(3)] == [tables[0], tables[1].split("\n")[0], tables[2].split("\n")[0]]


def test_odd_rows(spark):
    line = "x y z a b c d e f g"
    long = "\n".join(f"line number {i} of a very long text {'w' * (i % 50)}" for i in range(20_000))
    docs = spark.createDataFrame([row(1, None), row(2, ""), row(3, line), row(3, line), row(5, long)], SCHEMA)
    got = linededup.drop_recurring_lines(docs)
    assert got.columns == [*docs.columns, "n_dropped"] and got.where("n_dropped > 0").count() == 0 and got.count() == 5
    assert linededup.drop_recurring_lines(docs.limit(0)).count() == 0
    # rows without an id are together one document that comes first; which of its rows is first, a hash of the text decides
    ids = [row(None, line), row(None, line), row(None, f"own\n{line}")]
    got = linededup.drop_recurring_lines(docs.unionByName(spark.createDataFrame(ids, SCHEMA))).where("doc_id is null or doc_id < 5").collect()
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in got if r.doc_id and r.text is not None) == [(2, "", 0), (3, "", 1), (3, "", 1)]
    assert sorted((r.text, r.n_dropped) for r in got if r.doc_id is None) in ([("own", 1), (line, 0), (line, 0)], [("", 1), ("", 1), (f"own\n{line}", 0)])


def test_rows_of_one_id_are_told_apart(spark):
    a, b = "a line that two of the documents share", "a unique one that must not get lost here"
    docs = spark.createDataFrame([row(1, a), row(3, a), row(3, b), row(3, a)], SCHEMA)
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in linededup.drop_recurring_lines(docs).collect()) == [(1, a, 0), (3, "", 1), (3, "", 1), (3, b, 0)]


def test_columns_with_clashing_names(spark):
    names = "doc_id bigint, text string, n_dropped int, row string, doc int, tie int, gone string, _doc string, leaf int"
    docs = spark.createDataFrame([(i, "the same line in both of them", 7, "r", i, i, "g", "d", i) for i in (1, 2)], names)
    got = linededup.drop_recurring_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "n_dropped"] + ["n_dropped"]
    assert [(r.doc_id, r.n_dropped, r.row, r.gone, r.leaf) for r in got.orderBy("doc_id").collect()] == [(1, 0, "r", "g", 1), (2, 1, "r", "g", 2)]
    assert linededup.drop_recurring_lines(docs, count_col=None).columns == docs.columns


def test_plan_is_native(spark):
    docs = spark.createDataFrame([row(1, "a b c d e f")], SCHEMA)
    plan = linededup.drop_recurring_lines(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_a_leaf_has_several_templates(spark):
    first = "the quick brown cat sat on my old mat twice"
    base = "the quick brown fox jumps over the lazy dog today"
    words = "a few wholly different words of some length here stand apart".split()
    long = ["we all know " + " ".join(words[(i * k) % len(words)] for i in range(1, 40)) for k in (1, 2, 3)]
    other = " ".join("changed" if i in (7, 19, 33) else w for i, w in enumerate(long[2].split(" ")))
    rows = [row(1, f"{first}\n{long[0]}"), row(2, f"{base}\n{long[1]}"), row(3, base.replace("today", "again")), row(4, long[2]), row(5, other), row(6, base.replace("fox", "bear"))]
    got = run(spark, rows)
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6)] == [f"{first}\n{long[0]}", f"{base}\n{long[1]}", "", long[2], "", ""]
    assert {i: x[0] for i, x in got.items()} == brute([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("chunk", [7, 1000])
def test_lines_against_one_after_the_other(spark, monkeypatch, chunk):
    monkeypatch.setattr(linededup, "further_templates", partial(linededup.further_templates, chunk=chunk))
    for seed in (3, 4):
        random.seed(seed)
        texts = []
        for n in (4, 5, 7, 9, 10, 12, 16, 20):
            texts += [" ".join(["so", "it", "is", *(random.choice("abc" if n < 9 else "ab") for _ in range(n - 3))]) for _ in range(40)]
        texts += [f"item {random.randrange(9)} {random.choice('xyz')} costs {random.randrange(99)} or {random.choice('uvw')} more" for _ in range(60)]
        random.shuffle(texts)
        docs = [(i, "\n".join(texts[4 * i : 4 * i + 4])) for i in range(len(texts) // 4)]
        got = run(spark, [row(i, x) for i, x in docs])
        assert {i: x[0] for i, x in got.items()} == brute(docs)


def test_white_space_of_any_kind_separates_tokens(spark):
    a, b, c = ("\t".join("name of the place is always told as".split() + [w]) for w in ("here", "there", "elsewhere"))
    got = run(spark, [row(1, a), row(2, f"{b}\nown\ttext"), row(3, c.replace("\t", "\u2003\u3000") + "\r")])
    assert [got[i][0] for i in (1, 2, 3)] == [a, "own\ttext", ""]


def test_query_against_one_line_after_the_other(spark):
    from pitchlake.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    import hashlib

    expected = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in brute(docs).items()}
    assert {r.doc_id: r.text_sha256 for r in queries.op8_line_templates(spark, sf).collect()} == expected


def test_a_leaf_of_unlike_lines_that_share_parts(spark):
    """Two thousand lines of one leaf that all end alike, and one that is alike to the last of them: two chunks."""
    r = random.Random(6)
    words = ["".join(r.choice("bcdfgaeiou") for _ in range(5)) for _ in range(400)]
    lines = [" ".join(["posted", "in", "the", *r.sample(words, 5), "read", "more", "of", "this"]) for _ in range(2000)]
    alike = " ".join("other" if k == 4 else w for k, w in enumerate(lines[-1].split(" ")))
    rows = [row(k // 10, "\n".join(lines[k : k + 10])) for k in range(0, 2000, 10)] + [row(500, alike)]
    began = time.time()
    got = run(spark, rows)
    assert time.time() - began < 120
    assert got[500][0] == "" and all(got[i][0] == t for i, t, *_ in rows[:-1])
