"""Names of persons and teams: normal form and likeness."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import jsround

THRESHOLD = 0.86


@cache
def bases() -> tuple[str, str]:
    """Characters beyond ASCII whose canonical decomposition has a letter a-z, a digit or a white space, and that, in lower case.

    A text's decomposition is that of its characters one by one, but for the order of marks, which are dropped. None has more
    than one such letter.
    """
    found = {}
    for code in range(0x80, 0x110000):
        c = chr(code)
        if unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<"):
            base = "".join(x for x in unicodedata.normalize("NFD", c).lower() if x.isascii() and (x.isalnum() or x.isspace()))
            if base:
                found[c] = base
    return "".join(found), "".join(found.values())


def normalise_name(c: Column) -> Column:
    """Lower case without marks, only letters a-z, digits and single spaces."""
    plain = F.lower(F.translate(c, *bases()))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s]", ""), r"\s+", " "))


def shared_tokens(left: Column, right: Column) -> Column:
    """Tokens of the left name that find one of their own in the right, in order; an initial stands for a word."""
    one = lambda c: F.length(c) == 1
    same = lambda t, o: (t == o) | (one(t) & F.startswith(o, t)) | (one(o) & F.startswith(t, o))

    def step(state: Column, token: Column) -> Column:
        k = F.array_position(F.transform(state["free"], lambda o: same(token, o)), F.lit(True)).cast("int")
        rest = F.concat(F.slice(state["free"], F.lit(1), F.greatest(k - 1, F.lit(0))), F.slice(state["free"], k + 1, F.size(state["free"])))
        return F.struct(F.when(k > 0, rest).otherwise(state["free"]).alias("free"), (state["n"] + (k > 0).cast("int")).alias("n"))

    start = F.struct(F.split(right, " ").alias("free"), F.lit(0).alias("n"))
    return F.aggregate(F.split(left, " "), start, step, lambda s: s["n"])


def likeness(left: Column, right: Column) -> Column:
    """Likeness of two normal forms, 0 to 1, 3 decimals: edit distance weighs 0.35, shared tokens 0.65."""
    ratio = 1 - F.levenshtein(left, right) / F.greatest(F.length(left), F.length(right))
    tokens = shared_tokens(left, right) / F.greatest(F.size(F.split(left, " ")), F.size(F.split(right, " ")))
    return F.when(left == right, 1.0).when((F.length(left) == 0) | (F.length(right) == 0), 0.0).otherwise(jsround(ratio * 0.35 + tokens * 0.65, 3))


def name_similarity(a: Column, b: Column) -> Column:
    return likeness(normalise_name(a), normalise_name(b))
