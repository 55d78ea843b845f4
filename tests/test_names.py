"""Normal names against Python's own decomposition, contains-search against Python's own, canonical texts."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from datetime import date

import pytest
from pyspark.sql import functions as F

from pitchlake.functions.names import normalise_name
from pitchlake.operators import ngrams, payloads


def plain(x: str) -> str:
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub(r"[^a-z0-9 \t\n\x0b\f\r]", "", unicodedata.normalize("NFD", x).lower())).strip(" ")


def test_every_code_point(spark):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    frame = spark.createDataFrame([(c, f"x{chr(c)}y") for c in codes], "c int, t string").repartition(4)
    out = frame.select("c", normalise_name(F.col("t")).alias("n"))
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
    got = dict(map(tuple, out.collect()))
    wrong = [hex(c) for c in codes if got[c] != plain(f"x{chr(c)}y")]
    assert not wrong, wrong[:20]
    assert [r.n for r in spark.createDataFrame([("  Zoë  Ångström-O'Néill\t2 ",), ("ȩ́",), (None,)], "t string").select(normalise_name(F.col("t")).alias("n")).collect()] == ["zoe angstromoneill 2", "e", None]


@pytest.mark.parametrize("seed", [1, 2])
def test_containing(spark, seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcé ") for _ in range(n))
    labels = list({word(r.randrange(14)) for _ in range(150)}) + ["a" * 3000, None]
    terms = list({word(r.randrange(7)) for _ in range(120)}) + ["zzz", "", "a" * 50, None]
    index = ngrams.postings(spark.createDataFrame([(x,) for x in labels + labels[:5]], "label string"))
    got = sorted(map(tuple, ngrams.containing(index, spark.createDataFrame([(t,) for t in terms], "term string")).collect()))
    assert got == sorted((t, x) for t in terms if t for x in labels if x is not None and t in x)
    assert index.where("label = repeat('a', 3000)").count() == 3


def test_canonical_text(spark):
    kind = "a string, b int, c double, d boolean, e array<struct<z:string,y:double>>, f date, g map<string,int>"
    frame = spark.createDataFrame([('q"\\', 3, 0.1234565, True, [("x", 1.0), (None, None)], date(2024, 1, 2), {"k": 1, "a": 0}), (None,) * 7], kind)
    text = [r.t for r in frame.select(payloads.canonical_text(F.struct("g", "f", "e", "d", "c", "b", "a"), frame.select("g", "f", "e", "d", "c", "b", "a").schema).alias("t")).collect()]
    assert text[0] == r'{"a":"q\"\\","b":3000000,"c":123457,"d":true,"e":[{"y":1000000,"z":"x"},{"y":null,"z":null}],"f":"2024-01-02","g":[{"key":"a","value":0},{"key":"k","value":1000000}]}'
    assert text[1] == '{"a":null,"b":null,"c":null,"d":null,"e":null,"f":null,"g":null}'
    one = frame.select(payloads.snapshot_id(F.struct(*frame.columns), frame.schema).alias("s")).first().s
    assert one == hashlib.sha256(text[0].encode()).hexdigest()[:32]


def test_equal_names_meet_once(spark):
    """Many players of few names: the pairs that are compared are those of different names, and each player finds the least id."""
    from pitchlake.operators import entity

    names = ["Ann Small", "Bo Small", "Cy Large"]
    known = spark.range(600).selectExpr("id AS player_id", "element_at(array('Ann Small', 'Bo Small', 'Cy Large'), CAST(id % 3 AS INT) + 1) AS full_name", "date_add(DATE'2000-01-01', CAST(id % 2 AS INT)) AS birth_date")
    new = spark.range(300).selectExpr("id AS incoming_id", "element_at(array('A. Small', 'B. Small', 'Cy Large'), CAST(id % 3 AS INT) + 1) AS full_name", "CASE WHEN id % 4 = 0 THEN DATE'2000-01-02' END AS birth_date")
    texts = lambda df, lower, date, name: df.selectExpr(f"lower(full_name) AS {lower}", f"birth_date AS {date}", f"translate(lower(full_name), '.', '') AS {name}", *(c for c in df.columns if c.endswith("_id")))
    pairs = entity.name_pairs(texts(new, "lower", "birth_date", "name"), texts(known, "k_lower", "k_date", "k_name"))
    assert pairs.count() == 3 * len(names) + 2 * 2 + 1
    found = {r.incoming_id: r for r in entity.match_players(new, known, 0.5).collect()}
    assert len(found) == 300
    for k, r in found.items():
        least = next(i for i in range(6) if i % 3 == k % 3 and (k % 4 or i % 2 == 1))
        assert (r.player_id, r.method) == (least, "EXACT" if k % 4 == 0 and k % 3 == 2 else "FUZZY")
