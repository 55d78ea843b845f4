"""Surrogates for personal data, in DataFrame functions alone.

One pattern finds e-mail addresses, secrets, IBANs, card numbers, IPv4 addresses, telephone numbers and names after a
title. In documents with such names, later mentions without a title are found too: capitalised words that are a surname
there, and the given name before it. A text is cut at the entities; each entity becomes a surrogate of its type, and the
pieces are joined again. An entity's canonical form decides about its surrogate: case folded but for secrets with a prefix
(hexadecimal digits fold), separators removed, a telephone number's last ten digits, a name without its title. So an entity
has one surrogate in the whole corpus, written in the format of each mention: separators, country codes and prefixes of
secrets stay in place, digits become digits, letters letters of their case and script, each text keeps its length but for
names and addresses, card numbers and IBANs keep valid check digits if they had them, names keep title, gender, particles
and script.

A given name after a title that says nothing about gender is that of the same name's first title in the document that does, or
else in the corpus (the more frequent one, men's where there are as many). It stands for one person's name in either case.

Surrogates come from a keyed hash and an attempt number. All distinct entities are held against each other, given names of
all genders too: where two would get one surrogate, or a surrogate is an entity of the corpus, all but the least entity try
the next number, until none collides. Made-up names grow with the number, so there are enough of them for any corpus; what must keep its length
(numbers, accounts, secrets) is refused once ROUNDS rounds in a row have settled none of it. Only entities are shuffled
for that, and only those redrawn that lost; texts with entities are shuffled once, to meet their replacements, and the
others not at all. All texts are stored once with what was found in them, so that they are searched once.

Defined results: null texts stay null; texts without entities are unchanged; repeated rows get equal results (rows of
one id are told apart by their text); rows without an id are treated like others; other columns pass unchanged (n_chars,
where given, follows the text; a column with the name of the count is replaced); an empty table gives an empty one. A
surname of a document that is also a common word there is replaced wherever it is capitalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_path, stored

#: Titles of men, of women and of either, by script.
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir", "Don", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Lady", "Doña", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof", "Доктор"),
}
#: A capitalised word; apostrophes and hyphens belong to it where letters follow, but for a possessive s.
_NAME = r"\p{Lu}(?:\p{L}|['’](?!s?(?!\p{L}))|-(?=\p{L}))+"
#: Words in lower case that are part of a name, and what secrets start with.
PARTICLES = "van von der den de del della di da dos das la le ten ter zu af av bin al el".split()
PREFIX = "(?:sk|pk|ghp|key)[-_]"
ABBREVIATED = "Mr Mrs Ms Sr Sra Mme Dr Prof".split()
#: Titles as they are written or in capitals; abbreviated ones also in lower case if a full stop follows.
_WRITTEN = [x for v in TITLES.values() for t in v for x in dict.fromkeys((t, t.upper()))]
_FIRST = "[" + "".join(sorted({t[0] for t in _WRITTEN})) + "]"
_TITLES = f"(?={_FIRST})(?:{'|'.join(_WRITTEN)})|(?:{'|'.join(t.lower() for t in ABBREVIATED)})(?=\\.)"
_PARTICLE = rf"(?: (?:{'|'.join(PARTICLES)})(?!\p{{L}}))*"
#: What finds each type, in the order in which alternatives are tried.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|" + PREFIX + r"[A-Za-z0-9]{16,})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9.-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\(?(?<![0-9])[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.?{_PARTICLE} {_NAME}(?:{_PARTICLE} {_NAME}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Also capitalised words, for documents in which names are known.
WIDE = rf"{ANY}|(?<!\p{{L}}){_NAME}"
#: What every text with an entity has: a digit, an at sign, the start of a secret or a title. Far cheaper to look for than ANY.
HINT = rf"[0-9@]|[a-fA-F]{{32}}|{PREFIX}|(?={_FIRST})(?:{'|'.join(_WRITTEN)})\.? |[mdsp](?:rs?|s|ra|me|rof)\. "
#: Given names by script and gender, the endings of made-up ones, and the syllables of made-up names.
GIVEN = {
    ("latin", "m"): "adrian bruno conrad damian edgar felix gregor hugo ivan jonas kilian lorenz marius nestor oscar pascal".split(),
    ("latin", "f"): "alma berta clara daria elisa flora greta hanna irene julia klara lydia marta nadia olga petra".split(),
    ("cyrillic", "m"): "антон борис виктор глеб денис егор захар игорь".split(),
    ("cyrillic", "f"): "алина белла вера галина дарья елена зоя ирина".split(),
    ("greek", "m"): "αλέξης βασίλης γιάννης δήμος ηλίας θάνος κώστας λάμπρος".split(),
    ("greek", "f"): "άννα βάσω γιάννα δάφνη ελένη ζωή ηρώ θάλεια".split(),
}
ENDINGS = {("latin", "m"): "us", ("latin", "f"): "ia", ("cyrillic", "m"): "ан", ("cyrillic", "f"): "ина", ("greek", "m"): "ος", ("greek", "f"): "ία"}
SYLLABLES = {
    "latin": "ba bel bor da den dor fa fer ga gel hal har ka kel lan len lo ma mar mel na nel no or pa per ra ren ro sa sel ta ter to va ven vo wal we wil".split(),
    "cyrillic": "ба бел бор ва вен гор да дол за зор ка кол ла лен ма мар на нов ор па пет ра ро са сел та тер".split(),
    "greek": "βα γε δα δο ζα θα κα κο λα λι μα μι να νι πα πο ρα ρο σα σι τα το φα χα".split(),
}
LOWER, UPPER, ROUNDS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 40
#: Attempts after which a made-up name gets another syllable.
GROW = 3
_TITLE = rf"^({_TITLES})\.? "


def type_of(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def entities(mention: Column) -> Column:
    """The entities (kind, canon) of a mention, in its order: a name's given names and surname, else the mention itself."""
    kind = type_of(mention)
    words = F.split(F.regexp_replace(mention, _TITLE, ""), " ")
    title = F.initcap(F.lower(F.regexp_extract(mention, _TITLE, 1)))
    given = F.when(title.isin(*TITLES["f"]), "given_f").when(title.isin(*TITLES["m"]), "given_m").otherwise("given_n")
    entity = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    names = F.filter(words, lambda w: ~w.isin(*PARTICLES))
    of_name = F.transform(names, lambda w, i: entity(F.when(i == F.size(names) - 1, "surname").otherwise(given), F.lower(w)))
    digits = F.regexp_replace(mention, "[^0-9]", "")
    plain = F.when(kind.isin("email", "ip") | (kind == "secret") & ~mention.rlike(f"^{PREFIX}"), F.lower(mention)).when(kind == "secret", mention)
    plain = plain.when(kind == "phone", F.right(digits, F.lit(10))).otherwise(F.regexp_replace(F.upper(mention), "[^A-Z0-9]", ""))
    return F.when(kind != "name", F.array(entity(kind, plain))).otherwise(of_name)


def key_of(entity: Column) -> Column:
    return F.concat_ws(":", entity["kind"], entity["canon"])


def luhn(digits: Column) -> Column:
    """The digit sum that a valid card number has as a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(2 * c.cast("int"), F.lit(10)) + F.floor(2 * c.cast("int") / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def mod97(account: Column) -> Column:
    """The remainder by 97 of an account number whose first four characters stand last; 1 if its check digits are valid."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


def let(value: Column, body) -> Column:
    """body of a value that is computed once for a row, also where body uses it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def _pick(words: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(number, F.lit(len(words))) + 1).cast("int"))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of an entity's surrogate, by a keyed hash of kind, canon and attempt."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)
    # numbers of 8 bits, 32 a hash, as many as the entity has characters and 96 at least; hashed once, not for each character
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(2), F.floor(F.length(canon) / 32).cast("int"))), lambda i: F.sha2(F.concat_ws("|", F.lit(key), seed, i.cast("string")), 256))
    return let(F.array_join(hashes, ""), lambda stream: _surrogate(kind, canon, attempt, key, seed, stream))


def _surrogate(kind: Column, canon: Column, attempt: Column, key: str, seed: Column, stream: Column) -> Column:
    byte = lambda i: F.conv(F.substring(stream, 2 * F.lit(i) + 1 if isinstance(i, int) else i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    gender = F.when(kind == "given_n", F.when(byte(40) % 2 == 0, "m").otherwise("f")).otherwise(F.right(kind, F.lit(1)))
    number = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), seed, F.lit("syllable"), i.cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    more = lambda parts: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / GROW).cast("int")), lambda i: F.when(i == 0, "").otherwise(_pick(parts, number(i)))), "")
    made = {s: F.concat(*(_pick(parts, byte(2 * i) * 256 + byte(2 * i + 1)) for i in range(3)), more(parts)) for s, parts in SYLLABLES.items()}
    surname = given = F.lit(None).cast("string")
    for (s, g), names in GIVEN.items():
        surname = F.when(script == s, made[s]).otherwise(surname)
        given = F.when((script == s) & (gender == g), F.when(attempt == 0, _pick(names, byte(41))).otherwise(F.concat(made[s], F.lit(ENDINGS[s, g])))).otherwise(given)
    email = F.concat(made["latin"], F.lit("."), F.lpad(F.pmod(byte(50) * 65536 + byte(51) * 256 + byte(52), F.lit(100_000)).cast("string"), 5, "0"), F.lit("@"), _pick(SYLLABLES["latin"], byte(53)), _pick(SYLLABLES["latin"], byte(54)), F.lit(".example"))
    ip = F.concat_ws(".", *((F.pmod(byte(60 + i), F.lit(223)) + 1).cast("string") for i in range(4)))
    # letters and digits become others of their kind; country codes of accounts and prefixes of secrets stay
    keep = F.when(kind == "iban", 2).when(kind == "secret", F.length(F.regexp_extract(canon, f"^{PREFIX}", 0))).otherwise(0)
    one = lambda text, i: F.substring(F.lit(text), F.pmod(byte(i), F.lit(len(text))) + 1, F.lit(1))
    drawn = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(i < keep, c).when(c.between("0", "9"), one("0123456789", i)).when((kind == "secret") & (keep == 0) & c.between("a", "f"), one("abcdef", i)).when(c.between("a", "z"), one(LOWER, i)).when(c.between("A", "Z"), one(UPPER, i)).otherwise(c)), "")
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = F.pmod(10 - F.pmod(luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(luhn(canon), F.lit(10)) == 0, F.concat(body, check)).otherwise(drawn)
    digits = F.lpad((98 - mod97(F.concat(F.substring(drawn, 1, 2), F.lit("00"), F.substring(drawn, 5, 64)))).cast("string"), 2, "0")
    valid = F.concat(F.substring(drawn, 1, 2), digits, F.substring(drawn, 5, 64))
    iban = F.when(mod97(canon) == 1, valid).otherwise(drawn)
    made = {"email": email, "ip": ip, "card": card, "iban": iban, "surname": surname}
    out = F.when(kind.startswith("given"), given).otherwise(drawn)
    for name, value in made.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def dictionary(found: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(kind, canon, surrogate) for the distinct entities of found; no surrogate is another's, or an entity of the corpus.

    In each round those that are still open draw. Whoever draws what no entity and nobody settled has, and is the least
    of those that draw it, is settled for good; only the others go on.
    """
    spark, path = found.sparkSession, shared_path(found.sparkSession, "surrogates")
    space = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind")).alias("space")  # within which surrogates are distinct
    known = stored(found.select("kind", "canon").distinct(), "entities")
    names = known.select(space, F.col("canon").alias("surrogate")).distinct()
    left, taken, number, open_before, idle = known.withColumn("attempt", F.lit(0)), names, 0, None, 0
    while True:
        drawn = stored(left.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)), "drawn")
        first = drawn.groupBy(space, "surrogate").agg(F.min(F.struct("canon", "kind")).alias("e"))
        free = first.join(taken, ["space", "surrogate"], "left_anti")
        free.select("e.kind", "e.canon", "surrogate").write.parquet(f"{path}/{number}")
        new = spark.read.schema("kind string, canon string, surrogate string").parquet(f"{path}/{number}")
        settled = spark.read.schema("kind string, canon string, surrogate string").option("recursiveFileLookup", True).parquet(path)
        left = stored(drawn.join(new, ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), "open")
        still = left.count()
        if not still:
            return settled
        # those that are settled never become fewer
        idle = idle + 1 if still == open_before else 0
        if idle >= rounds:
            raise RuntimeError(f"{still} surrogates still collide, and {rounds} rounds have settled none of them")
        open_before, number = still, number + 1
        taken = names.unionByName(settled.select(space, "surrogate"))


def gendered(each: DataFrame) -> DataFrame:
    """each (doc, tie, at, kind, canon) with `of`, the kind under which the entity has its surrogate: given names after a title of
    either gender take that of the name in the document, or in the corpus, where it is known there."""
    given = each.where(F.col("kind").isin("given_m", "given_f"))
    in_doc = given.groupBy(F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), "canon").agg(F.min(F.struct("at", "kind"))["kind"].alias("here"))
    men = F.sum(F.when(F.col("kind") == "given_m", 1).otherwise(-1)) >= 0
    in_corpus = given.groupBy("canon").agg(F.when(men, "given_m").otherwise("given_f").alias("anywhere"))
    open_, closed = each.where("kind = 'given_n'"), each.where("kind <> 'given_n'").withColumn("of", F.col("kind"))
    own = F.col("o.doc").eqNullSafe(F.col("d._doc")) & (F.col("o.tie") == F.col("d._tie")) & (F.col("o.canon") == F.col("d.canon"))
    known = open_.alias("o").join(in_doc.alias("d"), own, "left").select("o.*", "here").join(in_corpus, "canon", "left")
    return closed.unionByName(known.select(*each.columns, F.coalesce("here", "anywhere", "kind").alias("of")))


def _cased(part: Column, new: Column) -> Column:
    """A made-up name with the capitals of the name that it stands for."""
    return F.when((F.length(part) > 1) & (F.upper(part) == part), F.upper(new)).otherwise(F.initcap(new))


def written(mention: Column, names: Column) -> Column:
    """A mention's surrogate in the mention's format, null if it is no entity; names: map from key_of() to surrogates."""
    kind, own = type_of(mention), entities(mention)
    first = names[key_of(own[0])]
    case = F.when((F.upper(mention) == mention) & (F.lower(mention) != mention), F.upper(first)).otherwise(first)
    title = F.regexp_extract(mention, rf"{_TITLE[:1]}({_TITLE[1:]})", 1)
    parts = F.split(F.regexp_replace(mention, _TITLE, ""), " ")
    # particles stay; of the others the last is the surname, and a given name's gender is the mention's
    gender = own[0]["kind"]
    entity = lambda i: F.when(i == F.size(parts) - 1, "surname").otherwise(gender)
    new = lambda w, i: F.when(w.isin(*PARTICLES), w).otherwise(_cased(w, names[F.concat_ws(":", entity(i), F.lower(w))]))
    name = F.concat(title, F.array_join(F.transform(parts, new), " "))
    # separators of numbers stay in place, and what stands before the part of a telephone number that is replaced
    plain = F.regexp_replace(mention, "[^A-Za-z0-9]", "")
    before = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), "[^A-Za-z0-9]", "")) - F.length(plain) + F.length(first)
    placed = F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike("[A-Za-z0-9]") & (before(i) > 0), F.substring(first, before(i), F.lit(1))).otherwise(c))
    folded = kind.isin("email", "ip") | (kind == "secret") & ~mention.rlike(f"^{PREFIX}")
    of_kind = F.when(kind == "name", name).when(folded, case).when(kind == "secret", first).otherwise(F.array_join(placed, ""))
    return F.when(kind.isNotNull(), of_kind)


def bare(mentions: Column, gaps: Column, i: Column, names: Column) -> Column:
    """The surrogate of a capitalised word that is a surname of the document, or a given name right before one; else null."""
    word, after = F.get(mentions, i), F.get(mentions, i + 1)
    surname = lambda w: names[F.concat(F.lit("surname:"), F.lower(w))]
    given = F.coalesce(*(names[F.concat(F.lit(f"given_{g}:"), F.lower(word))] for g in "mfn"))
    follows = (F.get(gaps, i + 1) == " ") & surname(after).isNotNull()
    return F.coalesce(F.when(follows, _cased(word, given)), _cased(word, surname(word)))


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """docs with surrogates in the text, and their number as a last column."""
    text = F.col(f"`{text_col}`")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # so that no name can clash
    mentions = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), 0)).alias("mentions")
    marked = stored(docs.select(row, F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("tie"), mentions), "marked")
    has = F.coalesce(F.size("mentions") > 0, F.lit(False))
    found = marked.where(has).groupBy("doc", "tie").agg(F.min("mentions").alias("mentions"))
    own = F.posexplode(F.array_distinct(F.flatten(F.transform("mentions", entities)))).alias("at", "e")
    each = stored(found.select("doc", "tie", own).select("doc", "tie", "at", "e.*"), "entities")
    each = stored(gendered(each), "entities")
    entry = F.struct(key_of(F.struct("kind", "canon")).alias("k"), "surrogate")
    drawn = dictionary(each.select(F.col("of").alias("kind"), "canon"), key).withColumnRenamed("kind", "of")
    by_doc = each.join(drawn, ["of", "canon"]).groupBy("doc", "tie").agg(F.map_from_entries(F.collect_list(entry)).alias("names"))
    by_doc = stored(by_doc.withColumnsRenamed({"doc": "_doc", "tie": "_tie"}), "dictionary")
    joined = marked.where(has).join(by_doc, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")))

    body = F.col(f"row.`{text_col}`")
    named = F.exists(F.map_keys("names"), lambda k: k.startswith("surname:"))
    cut = joined.select("row", "names", F.when(named, F.regexp_extract_all(body, F.lit(WIDE), 0)).otherwise(F.col("mentions")).alias("mentions"),
                        F.when(named, F.split(body, WIDE, -1)).otherwise(F.split(body, ANY, -1)).alias("gaps"))
    m, g, n = F.col("mentions"), F.col("gaps"), F.col("names")
    cut = cut.withColumn("new", F.transform(m, lambda x, i: F.coalesce(written(x, n), bare(m, g, i, n))))
    piece = lambda x, i: F.concat(x, F.coalesce(F.get("new", i), F.get(m, i), F.lit("")))
    changed = cut.select("row", F.array_join(F.transform(g, piece), "").alias("text"), F.size(F.filter("new", lambda x: x.isNotNull())).alias("n"))
    columns = {text_col: F.col("text")} | ({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})
    kept = [c for c in docs.columns if c != count_col]
    done = changed.select(*(columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in kept), *([F.col("n").alias(count_col)] if count_col else []))
    same = marked.where(~has).select(*(F.col(f"row.`{c}`").alias(c) for c in kept), *([F.lit(0).alias(count_col)] if count_col else []))
    return same.unionByName(done)
