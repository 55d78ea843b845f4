"""Spelling variants: words one edit apart, by asymmetric q-chunks, and the common form that each stands for.

Of two near words the one that isn't the longer contributes two disjoint chunks, the halves into which it is cut. The other
contributes its positional grams: one edit leaves one of the two halves as it is, and that half stands in the other word at
the same place, or one place later if the edit is an insertion before it. So of all grams only those of the length of a half, for
a partner of equal length or one shorter, and within shift one, can ever meet a chunk: two for each of the two lengths. A
chunk and a gram that meet are a candidate, which the edit distance verifies.

A key that more than GROUP chunks and grams share (words of equal length that start or end alike) isn't compared all with
all: the rest of the word, in which the edit then must be, is cut in two again, so that a row gets two keys, each with more of
the word. That ends at a rest of one letter, where a group is bounded by the alphabet. No pair is lost at any level.

Words are counted within tasks before the shuffle, by a bounded dictionary. A form has ten times the occurrences of its
variant, so chains of forms are short; they are followed by doubling.

Defined results: a null text has no words; a word of a row without an id loses no letter; repeated rows count each; texts
are taken whole; only id and text are read, so extra columns can't clash; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, shared_path, stored

#: Code points of a word and its occurrences at least, how many times as common a form is, one of how many words loses a letter.
LEAST, OCCURRENCES, COMMON, THINNED = 7, 2, 10, 31
#: Rows that share a key up to which all are compared; words that a task counts before it passes them on.
GROUP, HELD = 256, 200_000
WORD = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST},}}")  # shorter ones never count


def thinned(word: str, seed: int) -> str:
    """The word without one of its letters, for one of THINNED checksums of the id and the word. seed: checksum of what stands before the word."""
    h = zlib.crc32(word.encode(), seed)
    return word if h % THINNED else word[: h % len(word)] + word[h % len(word) + 1 :]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thin: bool = False) -> DataFrame:
    """(word, n): the words of LEAST code points that occur OCCURRENCES times at least. thin: take letters from some, as thinned() does."""
    slim = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in pieces(batches):
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                own = Counter(WORD.findall((text or "").encode().lower().decode()))  # of bytes, so of A-Z alone
                if not thin or doc is None:
                    held.update(own)
                else:
                    seed = zlib.crc32(f"{doc}:".encode())
                    for word, n in own.items():
                        held[thinned(word, seed)] += n
                if len(held) >= HELD:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    found = slim.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= OCCURRENCES) & (F.length("word") >= LEAST))


ROW = ["word", "n", "longer", "low", "high"]


def _key() -> Column:
    """Of a row: the length of the word that gives chunks, and all of the word but the rest from low to high, which is longer by one in a word that is longer."""
    size = F.length("word") - F.col("longer")
    before = F.substring(F.col("word"), F.lit(1), F.col("low"))
    behind = F.substring(F.col("word"), F.col("high") + F.col("longer") + 1, size)
    return F.xxhash64(size, "low", "high", before, behind)


def chunked(found: DataFrame) -> DataFrame:
    """ROW and key: for each word its two halves as chunks, and as grams, these also for a partner that is one shorter."""
    half = lambda longer: F.floor((F.length("word") - longer) / 2).cast("int")
    size = lambda longer: F.length("word") - longer
    rest = lambda longer, low, high: F.struct(F.lit(longer).alias("longer"), low.cast("int").alias("low"), high.cast("int").alias("high"))
    both = lambda k: [rest(k, F.lit(0), half(k)), rest(k, half(k), size(k))]
    rests = F.when(F.length("word") > LEAST, F.array(*both(0), *both(1))).otherwise(F.array(*both(0)))
    return found.select("word", "n", F.explode(rests).alias("r")).select("word", "n", "r.*").withColumn("key", _key())


def halved(rows: DataFrame) -> DataFrame:
    """The rows with each rest cut in two."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    rests = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    return rows.select("word", "n", "longer", F.explode(rests).alias("r")).select("word", "n", "longer", "r.*").withColumn("key", _key())


def met(rows: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): verified pairs of chunks and grams with one key; of two words of equal length a is the lesser."""
    chunk = rows.where("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    gram = rows.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    order = (F.col("longer") == 1) | (F.col("a") < F.col("b"))
    return chunk.join(gram, "key").where(order & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def near_words(found: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words of found (word, n) that differ by one inserted, deleted or replaced code point, once."""
    spark, path, level = found.sparkSession, shared_path(found.sparkSession, "near-words"), 0
    rows = stored(chunked(found), "chunks")
    while True:
        shared = stored(rows.groupBy("key").count().where(F.col("count") > group).select("key", F.lit(True).alias("hot")), "hot-keys")
        if shared.isEmpty():
            met(rows).write.parquet(f"{path}/{level}")
            break
        # what can't be cut any further is bounded by the alphabet
        marked = rows.join(shared, "key", "left").withColumn("hot", F.col("hot").isNotNull() & (F.col("high") - F.col("low") > 1))
        marked = stored(marked, "marked")
        met(marked.where("not hot").drop("hot")).write.parquet(f"{path}/{level}")
        rows, level = stored(halved(marked.where("hot")), "chunks"), level + 1
    pairs = spark.read.schema("a string, a_n bigint, b string, b_n bigint").option("recursiveFileLookup", True).parquet(path)
    return pairs.distinct()


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of forms (word, form) along the forms to the last one."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(found: DataFrame, common: int = COMMON, group: int = GROUP) -> DataFrame:
    """For each word of found (word, n): word, form (its near word of largest n, the first of several, if that has `common` times
    the word's n; else null), root (the last form of the chain, or the word itself), n, n_near and form_n."""
    found = stored(found, "words")
    pairs = stored(near_words(found, group), "pairs")
    sides = F.array(*(F.struct(F.col(x).alias("word"), F.struct((-F.col(f"{y}_n")).alias("k"), F.col(y).alias("form")).alias("near")) for x, y in ("ab", "ba")))
    by_word = pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    is_form = -F.col("best.k") >= common * F.col("n")
    told = found.join(by_word, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.k")).alias("form_n")
    )
    told = stored(told, "forms")
    roots = followed(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB SQL of the registered query: all words without one letter, instead of chunks.
ORACLE = rf"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w
  FROM documents WHERE text IS NOT NULL),
own AS (SELECT id, w, count(*) AS n FROM runs WHERE length(w) >= {LEAST} GROUP BY id, w),
coded AS (SELECT *, hex(encode(coalesce(id, '') || ':' || w)) AS x FROM own),
bytes AS (SELECT *, list_transform(range(1, length(x), 2), lambda k: CAST('0x' || substr(x, k, 2) AS BIGINT)) AS b FROM coded),
summed AS (
  SELECT id, w, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, v: xor(c // 256, t[xor(c % 256, v) + 1])), 4294967295) AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN id IS NOT NULL AND h % {THINNED} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut GROUP BY word HAVING sum(n) >= {OCCURRENCES} AND length(word) >= {LEAST}),
places AS (SELECT word, n, unnest(range(length(word))) AS p FROM words),
less AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM places),
near AS (
  SELECT DISTINCT a.word AS a, b.word AS b, b.n AS n FROM less a JOIN less b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT a AS word, count(*) AS n_near, max(n) AS most, arg_min(b, {{'k': -n, 'b': b}}) AS b FROM near GROUP BY a),
told AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {COMMON} * n THEN b END AS form, CASE WHEN most >= {COMMON} * n THEN most END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM told
  UNION ALL SELECT c.word, t.word, t.form FROM chain c JOIN told t ON t.word = c.next)
SELECT t.word, t.form, c.root, t.n, t.n_near, t.form_n FROM told t JOIN chain c ON c.word = t.word AND c.next IS NULL
"""
