"""Line deduplication by a log-template tree, in DataFrame functions alone.

White space of any kind separates tokens. Tokens with digits are variable fields. A line goes down a tree of fixed depth:
by its number of tokens, then by its leading tokens. A leaf has a list of templates: its first line (least document, then
line), and each line that is unlike all templates before it. A line takes the first template of its leaf with which at
least SIMILAR of its tokens agree in place. Lines of fewer than SHORT tokens have no room for fields without digits: they
take a template only by their exact masked form. A template that recurs in several documents is dropped everywhere but at
its first place, so that one copy of what documents share is kept.

What is masked: a token with a digit; in a line with a script without spaces only its digits. A line of which nothing but
fields is left stands for itself, so that rows of numbers aren't taken for each other.

The lines are parsed once, into hashes of leaf and masked form, and summed to distinct forms before the shuffle; all that
follows is about forms, and only those of leaves that hold several need their texts. Texts move twice: to fetch these
forms, and to meet the lines that are dropped. The joins on hot leaves and forms are plain ones whose large partitions
Spark splits. Alike forms share one of their signatures, so a form that shares none is a template without any comparison.
The others of a leaf are settled in the order of their places, in chunks of a bounded number of tokens: a chunk meets the
templates found so far through signatures, and what is left of it is settled in one go, one form after the other. A round
takes the next chunk of every leaf, so there are as many rounds as the largest leaf has chunks; most leaves have one.

Defined results: null texts stay null and lose no line; blank lines are always kept; rows with equal ids count as one
document, rows of one id are told apart by their text, and equal rows get equal results; rows without an id are together
one document that comes first; other columns pass unchanged (n_chars, where given, follows the text; a column with the
name of the count is replaced); a document that loses all lines stays with an empty text; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, stored

MIN_TOKENS, SHORT, LEADING, SIMILAR, DOCUMENTS = 1, 5, 3, 0.8, 2
#: Forms, and tokens of forms, that are settled in one go; forms at least, however many tokens they have.
CHUNK, TOKENS, FEWEST = 1000, 100_000, 16
FIELD = "<*>"
#: White space within lines, what shows that there may be other than single spaces, and scripts without spaces between words.
SPACE = r"[\s\p{Z}\x{85}&&[^\n]]+"
ODD_SPACE = ("  ", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0", chr(0x1680), chr(0x3000))
ODD_BYTES = (b"\xe2\x80", b"\xe2\x81")
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
FORM = ["leaf", "template"]


def let(value: Column, body) -> Column:
    """body of a value that is computed once for a row, also where body uses it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def spaced(text: Column) -> Column:
    """A text in which all white space within lines is one space."""
    # looking for bytes is far cheaper than a pattern
    signs = [text.contains(F.lit(x)) for x in ODD_SPACE]
    signs += [F.contains(text.cast("binary"), F.lit(x)) for x in ODD_BYTES]
    return F.when(reduce(lambda a, b: a | b, signs), F.regexp_replace(text, SPACE, " ")).otherwise(text)


def masked(line: Column) -> Column:
    """A line's form: fields in place of tokens with digits, or of digits alone where words aren't spaced."""
    tokens = F.regexp_replace(line, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)
    some = F.when(line.rlike(UNSPACED), F.regexp_replace(line, "[0-9]+", FIELD)).otherwise(tokens)
    return F.when(line.rlike("[0-9]"), F.when(F.trim(F.replace(some, F.lit(FIELD))) == "", line).otherwise(some)).otherwise(line)


def tokens_of(form: Column) -> Column:
    """The number of tokens between single spaces; 0 for an empty line."""
    return F.when(form == "", 0).otherwise(F.octet_length(form) - F.octet_length(F.replace(form, F.lit(" "))) + 1)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tie, text, row): rows of one id are told apart by tie; row holds all columns, so that no name can clash."""
    text = F.col(f"`{text_col}`")
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"), every.alias("row"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = MIN_TOKENS, leading: int = LEADING) -> DataFrame:
    """(doc, tie, line, leaf, template): each line of enough tokens with hashes of its leaf and of its form."""
    own = keyed(docs, id_col, text_col).select("doc", "tie", F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("line", "raw"))
    forms = own.select("doc", "tie", "line", masked(F.trim("raw")).alias("form")).withColumn("n", tokens_of(F.col("form")))
    hashed = F.xxhash64("form")
    leaf = F.when(F.col("n") < SHORT, F.xxhash64("n", "form")).otherwise(F.xxhash64("n", F.substring_index("form", " ", leading)))
    return forms.where(F.col("n") >= max(1, min_tokens)).select("doc", "tie", "line", leaf.alias("leaf"), hashed.alias("template"))


def place() -> Column:
    return F.struct("doc", "tie", "line")


def distinct_forms(every: DataFrame) -> DataFrame:
    """(leaf, template, place, last): the forms of lines(), with their least place and greatest document."""
    return every.groupBy(*FORM).agg(F.min(place()).alias("place"), F.max(F.struct("doc")).alias("last"))


def with_texts(forms: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """forms with their texts (form), from their least places."""
    at = forms.select("place.*", *FORM).groupBy("doc", "tie").agg(F.collect_list(F.struct("line", *FORM)).alias("wanted"))  # of one document
    at = at.withColumnsRenamed({"doc": "_doc", "tie": "_tie"})
    own = keyed(docs, id_col, text_col).select("doc", "tie", "text")
    joined = own.join(at.hint("merge"), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")))
    raw = let(F.split("text", "\n"), lambda x: F.transform("wanted", lambda w: F.struct(w["leaf"].alias("leaf"), w["template"].alias("template"), F.get(x, w["line"]).alias("raw"))))
    each = joined.select(F.explode(raw).alias("w")).select("w.*")
    found = each.select(*FORM, masked(F.trim(spaced(F.col("raw")))).alias("form"))
    return found.groupBy(*FORM).agg(F.min("form").alias("form"))  # equal rows give equal ones


def alike(a: str, b: str, similar: float) -> Column:
    """Whether at least `similar` of the tokens of two forms of equally many tokens agree in place."""
    agree = F.size(F.filter(F.zip_with(F.split(a, " "), F.split(b, " "), lambda x, y: x == y), lambda x: x))
    return agree >= similar * F.size(F.split(a, " ")) - 1e-9


def same_template(docs: DataFrame, forms: DataFrame, id_col: str, text_col: str, leading: int = LEADING, similar: float = SIMILAR) -> DataFrame:
    """(leaf, template, of, place, last): the forms of leaves that hold several, with the template (hash of its form) they take."""
    mixed = stored(forms.groupBy("leaf").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1").drop("n"), "leaves")
    own = stored(forms.join(mixed.hint("merge"), "leaf"), "mixed-forms")
    texts = stored(with_texts(own, docs, id_col, text_col), "texts")
    own = own.join(texts.hint("merge"), FORM)
    own = stored(own.select(*FORM, "place", "last", "form", (F.col("place") == F.col("first")).alias("is_first")), "forms-with-texts")
    seeds = own.where("is_first").select("leaf", F.col("template").alias("seed_template"), F.col("form").alias("seed"))
    seeded = own.join(seeds.hint("merge"), "leaf").withColumn("like_first", alike("form", "seed", similar))
    seeded = stored(seeded.select(*FORM, "place", "last", "form", F.when(F.col("like_first"), F.col("seed_template")).alias("of")), "seeded")
    found = further_templates(seeded.where("of is null").select(*FORM, "form", "place"), leading, similar)
    out = seeded.drop("form")
    if found is not None:
        out = out.withColumnRenamed("of", "seed").join(found.hint("merge"), FORM, "left").withColumn("of", F.coalesce("seed", "of")).drop("seed")
    return out.withColumn("of", F.coalesce("of", "template"))


def signatures(form: Column, leading: int, similar: float) -> Column:
    """Hashes of a form's tokens; two alike forms of a leaf have at least one in common.

    Alike forms differ in m tokens at most, all behind the leading ones. Of m + 2 parts of these tokens two are equal, of
    m + 1 one is. For m = 1, where each token is a part, all but one are.
    """
    def of(n: Column, free: Column) -> Column:
        m = (n - F.ceil(similar * n - 1e-9)).cast("int")
        f = F.greatest(n - leading, F.lit(1))
        two = (m >= 2) & (m <= 8) & (f >= m + 2)
        count = F.when(m == 1, f).when(two, m + 2).otherwise(F.least(m + 1, f))
        edge = lambda i: F.floor(i * f / count).cast("int")
        part = lambda i: F.xxhash64(i, F.array_join(F.slice(free, edge(i) + 1, edge(i + 1) - edge(i)), " "))
        parts = F.transform(F.sequence(F.lit(0), count - 1), part)
        hidden = lambda p, i: F.transform(p, lambda x, j: F.when(j == i, F.lit(0)).otherwise(x))
        without = lambda p: F.transform(p, lambda _, i: F.xxhash64(i, hidden(p, i)))
        after = lambda p, i: F.slice(p, i + 2, F.size(p))
        pairs = lambda p: F.flatten(F.transform(p, lambda x, i: F.transform(after(p, i), lambda y: F.xxhash64(x, y))))
        none = F.array().cast("array<bigint>")
        return let(parts, lambda p: F.when(m < 1, none).when(m == 1, without(p)).when(two, pairs(p)).otherwise(p))

    # tokens are split once, not for each part
    rest = lambda t: F.slice(t, F.lit(leading + 1), F.greatest(F.size(t) - leading, F.lit(0)))
    return let(F.split(form, " "), lambda t: let(rest(t), lambda free: of(F.size(t), free)))


def settled(rows: Column, place: str, similar: float) -> Column:
    """(template, at, of) for forms (place, template, tokens) in the order of their places: each takes the first template before it
    that it is alike to, or is one."""
    kind = f"array<struct<at:{place},of:bigint,tokens:array<bigint>>>"
    none = F.struct(F.array().cast(kind).alias("templates"), F.array().cast(f"array<struct<template:bigint,at:{place},of:bigint>>").alias("taken"))

    def near(a: Column, b: Column) -> Column:
        return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) >= similar * F.size(a) - 1e-9

    def step(seen: Column, row: Column) -> Column:
        def take(first: Column) -> Column:
            own = F.struct(row["place"].alias("at"), row["template"].alias("of"), row["tokens"].alias("tokens"))
            templates = F.when(first.isNull(), F.concat(seen["templates"], F.array(own))).otherwise(seen["templates"])
            taken = F.struct(row["template"].alias("template"), F.coalesce(first["at"], row["place"]).alias("at"), F.coalesce(first["of"], row["template"]).alias("of"))
            return F.struct(templates.alias("templates"), F.concat(seen["taken"], F.array(taken)).alias("taken"))

        return let(F.get(F.filter(seen["templates"], lambda t: near(t["tokens"], row["tokens"])), F.lit(0)), take)

    return F.aggregate(rows, none, step, lambda seen: seen["taken"])


def further_templates(forms: DataFrame, leading: int = LEADING, similar: float = SIMILAR, chunk: int = CHUNK) -> DataFrame | None:
    """(leaf, template, of): the template `of` that forms (leaf, template, form, place) take, for those that share a signature.

    The first of a leaf's forms in order is a template, and each one that is unlike all templates before it.
    """
    spark, path, kind = forms.sparkSession, shared_path(forms.sparkSession, "taken"), forms.schema["place"].dataType.simpleString()
    signed = stored(forms.select(*FORM, F.explode(F.array_distinct(signatures(F.col("form"), leading, similar))).alias("signature")), "signatures")
    groups = signed.groupBy("leaf", "signature").agg(F.count("*").alias("n")).where("n > 1").select("leaf", "signature")
    shared = stored(signed.join(groups.hint("merge"), ["leaf", "signature"]), "shared")
    tokens = F.transform(F.split("form", " "), lambda t: F.xxhash64(t))
    some = forms.join(shared.select(*FORM).distinct().hint("merge"), FORM).withColumn("tokens", tokens)
    size = F.greatest(F.lit(FEWEST), F.least(F.lit(chunk), F.floor(TOKENS / F.size("tokens")))) if chunk >= FEWEST else F.lit(chunk)
    number = F.row_number().over(Window.partitionBy("leaf").orderBy("place", "template"))
    some = stored(some.select(*FORM, "place", "tokens", F.floor((number - 1) / size).cast("int").alias("chunk")), "open")
    rounds = some.agg(F.max("chunk").alias("n")).first()["n"]
    if rounds is None:
        return None
    out = "leaf bigint, template bigint, at " + kind + ", of bigint"
    for k in range(rounds + 1):
        mine = some.where(F.col("chunk") == k)
        if k:
            before = spark.read.schema(out).option("recursiveFileLookup", True).parquet(path).where("of = template").select("leaf", "of", "at")
            known = before.join(some.select("leaf", F.col("template").alias("of"), F.col("tokens").alias("others")).hint("merge"), ["leaf", "of"])
            known = known.join(shared.select("leaf", F.col("template").alias("of"), "signature").hint("merge"), ["leaf", "of"])
            own = mine.select(*FORM, "tokens").join(shared.hint("merge"), FORM)
            agree = F.size(F.filter(F.zip_with("tokens", "others", lambda x, y: x == y), lambda x: x)) >= similar * F.size("tokens") - 1e-9
            met = own.join(known.hint("merge"), ["leaf", "signature"]).where(agree).groupBy(*FORM).agg(F.min(F.struct("at", "of")).alias("t"))
            met = stored(met.select(*FORM, "t.*"), "met")
            met.write.parquet(f"{path}/met-{k}")
            mine = mine.join(met.select(*FORM).hint("merge"), FORM, "left_anti")
        rows = mine.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("place", "template", "tokens"))).alias("rows"))  # of one chunk
        found = rows.select("leaf", F.explode(settled(F.col("rows"), kind, similar)).alias("t")).select("leaf", "t.*")
        found.write.parquet(f"{path}/settled-{k}")
    return spark.read.schema(out).option("recursiveFileLookup", True).parquet(path).select(*FORM, "of")


def recurring(docs: DataFrame, every: DataFrame, id_col: str, text_col: str, documents: int, leading: int, similar: float) -> DataFrame:
    """(leaf, template, first): the forms whose template stands in at least so many documents, and the template's first place."""
    forms = stored(distinct_forms(every), "forms")
    several = stored(same_template(docs, forms, id_col, text_col, leading, similar), "templates")
    whole = several.groupBy("leaf", "of").agg(F.min("place").alias("first"), F.max("last").alias("end"))
    taking = several.select(*FORM, "of").join(whole.hint("merge"), ["leaf", "of"])
    often = ~F.col("first.doc").eqNullSafe(F.col("end.doc"))
    single = forms.withColumnsRenamed({"place": "first", "last": "end"}).where(often).join(several.select(*FORM).hint("merge"), FORM, "left_anti")
    found = single.select(*FORM, "first", F.col("template").alias("of")).unionByName(taking.where(often).select(*FORM, "first", "of"))
    if documents > 2:  # count them: a row for each document and template before the shuffle
        found = stored(found, "several-documents")
        by = every.join(found.select(*FORM, "of").hint("merge"), FORM).select("leaf", "of", F.struct("doc").alias("d")).distinct()
        enough = by.groupBy("leaf", "of").count().where(F.col("count") >= documents).select("leaf", "of")
        found = found.join(enough.hint("merge"), ["leaf", "of"])
    return found.select(*FORM, "first")


def drop_recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, count_col: str | None = "n_dropped",
    min_tokens: int = MIN_TOKENS, leading: int = LEADING, similar: float = SIMILAR, documents: int = DOCUMENTS,
) -> DataFrame:
    """docs with the columns that it has, without the lines whose template recurs, and their number as a last column."""
    every = stored(lines(docs, id_col, text_col, min_tokens, leading), "lines")
    often = stored(recurring(docs, every, id_col, text_col, documents, leading, similar), "recurring")
    gone = every.join(often.hint("merge"), FORM).where(place() != F.col("first")).select(F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), "line")
    gone = gone.groupBy("_doc", "_tie").agg(F.array_sort(F.collect_set("line")).alias("gone"))  # of one document
    joined = keyed(docs, id_col, text_col).join(gone.hint("merge"), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left")
    # the stretches of lines between dropped ones
    edge = lambda k, x: F.when(k == 0, F.lit(-1)).when(k > F.size("gone"), F.size(x)).otherwise(F.get("gone", k - 1))
    piece = lambda k, x: F.slice(x, edge(k, x) + 2, edge(k + 1, x) - edge(k, x) - 1)
    stretch = lambda x: F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: piece(k, x))
    kept = F.array_join(F.flatten(let(F.split("text", "\n"), stretch)), "\n")
    same = F.col("gone").isNull()
    text = F.when(same, F.col("text")).otherwise(kept)
    changed = {text_col: text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(F.length(text).cast("long"))
    out = [changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c != count_col]
    return joined.select(*out, *([F.coalesce(F.size("gone"), F.lit(0)).alias(count_col)] if count_col else []))


#: DuckDB SQL of the registered query.
ORACLE = rf"""
WITH RECURSIVE
split AS (
  SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM documents WHERE text IS NOT NULL),
clean AS (SELECT doc, line, raw, trim(regexp_replace(raw, '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g'), ' ') AS own FROM split),
shaped AS (
  SELECT *, CASE WHEN regexp_matches(own, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}]')
    THEN regexp_replace(own, '[0-9]+', '{FIELD}', 'g') ELSE regexp_replace(own, '[^ 0-9]*[0-9][^ ]*', '{FIELD}', 'g') END AS shape
  FROM clean WHERE own <> ''),
lines AS (SELECT doc, line, CASE WHEN trim(replace(shape, '{FIELD}', ''), ' ') = '' THEN own ELSE shape END AS form FROM shaped),
forms AS (
  SELECT form, string_split(form, ' ') AS tokens, min((doc, line)) AS place, max(doc) AS last FROM lines GROUP BY form),
leaved AS (
  SELECT *, CASE WHEN len(tokens) < {SHORT} THEN tokens ELSE tokens[1:{LEADING}] END AS leaf, len(tokens) AS n FROM forms),
-- one template of each leaf a round: the first form that is unlike all templates before
taking AS (
  SELECT n, leaf, form, tokens, place, last, first_value(tokens) OVER (PARTITION BY n, leaf ORDER BY place) AS seed FROM leaved
  UNION ALL
  SELECT n, leaf, form, tokens, place, last, first_value(tokens) OVER (PARTITION BY n, leaf ORDER BY place) AS seed FROM taking
  WHERE len(list_filter(list_zip(tokens, seed), lambda p: p[1] = p[2])) < {SIMILAR} * n),
taken AS (
  SELECT form, place, last, array_to_string(seed, ' ') AS template FROM taking
  WHERE len(list_filter(list_zip(tokens, seed), lambda p: p[1] = p[2])) >= {SIMILAR} * n),
templates AS (SELECT template, min(place) AS first, max(last) AS last FROM taken GROUP BY template),
gone AS (
  SELECT doc, line FROM lines JOIN taken USING (form) JOIN templates t USING (template)
  WHERE t.first[1] <> t.last AND (doc, line) <> t.first),
per_doc AS (SELECT doc, count(DISTINCT line) AS n FROM gone GROUP BY doc),
kept AS (
  SELECT s.doc, string_agg(raw, chr(10) ORDER BY s.line) AS text
  FROM split s LEFT JOIN gone g ON s.doc = g.doc AND s.line = g.line WHERE g.doc IS NULL GROUP BY s.doc),
texts AS (
  SELECT d.doc_id, p.n, CASE WHEN p.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
  FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc LEFT JOIN kept k ON d.doc_id = k.doc)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_dropped, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM texts
"""
