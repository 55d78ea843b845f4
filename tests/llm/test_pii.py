import re

import regex
from pyspark.sql import functions as F

from pitchlake.llm import pii, queries


def run(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.text for r in pii.surrogates(docs, key).orderBy("doc_id").collect()]


def valid(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_formats_and_coreference(spark):
    a, b, c = run(spark, ["Write to John.Doe@mail.example.com, JOHN.DOE@MAIL.EXAMPLE.COM! +1 (564) 555-4526", "Card 4111 1111 1111 1111 or 4111-1111-1111-1111; IP 10.0.0.1, not 999.1.1.1", "john.doe@mail.example.com and 10.0.0.1"])
    m = re.fullmatch(r"Write to (\S+@\S+), (\S+@\S+)! \+1 \(\d{3}\) \d{3}-\d{4}", a)
    assert m and m[2] == m[1].upper() and "doe" not in a.lower() and "564" not in a
    n = re.fullmatch(r"Card (\d{4} \d{4} \d{4} \d{4}) or (\d{4}-\d{4}-\d{4}-\d{4}); IP ([\d.]+), not 999.1.1.1", b)
    assert n and n[1] == n[2].replace("-", " ") and valid(n[1]) and n[1] != "4111 1111 1111 1111"
    assert c == f"{m[1]} and {n[3]}"


def test_names_keep_title_gender_and_script(spark):
    a, b = run(spark, ["Mr. John Smith met Frau Anna Miller; Mr Smith left MR MILLER alone.", "Госпожа Анна Петрова, Herr Smith"])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Frau (\w+) (\w+); Mr (\w+) left MR (\w+) alone\.", a)
    assert m and m[2] == m[5] and m[6] == m[4].upper() and m[2] != "Smith" and m[1].lower() in pii.GIVEN["latin", "m"] and m[3].lower() in pii.GIVEN["latin", "f"]
    n = re.fullmatch(r"Госпожа ([А-Яа-я]+) ([А-Яа-я]+), Herr (\w+)", b)
    assert n and n[1].lower() in pii.GIVEN["cyrillic", "f"] and n[3] == m[2]


def test_surrogates_are_distinct_where_the_first_draw_collides(spark):
    names = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    found = spark.createDataFrame([("given_f", n) for n in names] + [("given_f", "alma"), ("card", "4111111111111111"), ("ip", "10.0.0.1")], "kind string, canon string")
    rows = pii.dictionary(found, "k").collect()
    assert len({(r.kind[:5], r.surrogate) for r in rows}) == len(rows) == len(names) + 3
    assert not {r.surrogate for r in rows} & {r.canon for r in rows}


def test_the_key_decides(spark):
    text = ["mail a.b@c.example"]
    assert run(spark, text) == run(spark, text) != run(spark, text, "other")


def test_query_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found, rows = re.compile(r"[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}|\b[0-9a-f]{40}\b|\b[0-9A-F]{40}\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b"), queries.op3_pii_surrogates(spark, sf).collect()
    pairs = {}
    for r in rows:
        old, new = found.findall(before[r.doc_id]), found.findall(r.text)
        assert len(old) == len(new) and found.split(before[r.doc_id]) == found.split(r.text) and r.n_entities == len(old)
        for a, b in zip(old, new):
            assert pairs.setdefault(a.lower(), b.lower()) == b.lower() != a.lower()
    assert pairs and len(set(pairs.values())) == len(pairs)


GENDER = {x: g for g, v in pii.TITLES.items() for t in v for x in (t, t.upper())}
SHORT = {t.lower(): g for g, v in pii.TITLES.items() for t in v if t in "Mr Mrs Ms Sr Sra Mme Dr Prof".split()}
TITLE = "|".join([*GENDER, *(rf"{t}(?=\.)" for t in SHORT)])
GENDER |= SHORT
PARTICLES = "van von der den de del della di da dos das la le ten ter zu af av bin al el".split()


def canon(mention):
    """Kind and entities (kind, canonical form) of a mention after the patterns of the types."""
    kind = next((k for k, p in pii.PATTERNS.items() if regex.fullmatch(p, mention)), None)
    if kind == "name":
        title, words = regex.match(rf"({TITLE})(?=\.? )", mention)[0], regex.sub(rf"^({TITLE})\.? ", "", mention).split(" ")
        words = [w.lower() for w in words if w not in PARTICLES]
        return kind, [(f"given_{GENDER[title]}", w) for w in words[:-1]] + [("surname", words[-1])]
    if kind == "phone":
        return kind, [(kind, re.sub("[^0-9]", "", mention)[-10:])]
    folded = kind in ("email", "ip") or kind == "secret" and not re.match("(sk|pk|ghp|key)[-_]", mention)
    return kind, [(kind, mention.lower() if folded else mention if kind == "secret" else re.sub("[^A-Z0-9]", "", mention.upper()))]


def resolved(texts):
    """For each text its entities with the kinds under which they have their surrogates."""
    own = [list(dict.fromkeys(e for m in regex.finditer(pii.ANY, t) for e in canon(m[0])[1])) for t in texts]
    votes = {}
    for t, w in {(i, e) for i, found in enumerate(own) for e in found}:
        if w[0] in ("given_m", "given_f"):
            votes[w[1]] = votes.get(w[1], 0) + (1 if w[0] == "given_m" else -1)
    out = []
    for found in own:
        here = {}
        for k, w in found:
            if k in ("given_m", "given_f"):
                here.setdefault(w, k)
        anywhere = lambda w: None if w not in votes else "given_m" if votes[w] >= 0 else "given_f"
        out.append({(k, w): (here.get(w) or anywhere(w) or k if k == "given_n" else k, w) for k, w in found})
    return out


def cased(old, new):
    return new.upper() if len(old) > 1 and old.upper() == old else new[0].upper() + new[1:].lower()


def brute(text, names):
    """A text with surrogates, and their number, by one mention after the other; names: (kind, canonical form) -> surrogate."""
    titled = [e for m in regex.finditer(pii.ANY, text) for e in canon(m[0])[1]]
    surnames, given = ({c: names[k, c] for k, c in titled if k.startswith(kind)} for kind in ("surname", "given"))
    out, at, n = "", 0, 0
    found = list(regex.finditer(pii.WIDE if surnames else pii.ANY, text))
    for i, m in enumerate(found):
        old, new = m[0], None
        kind, own = canon(old)
        if kind == "name":
            head = regex.match(rf"({TITLE})\.? ", old)[0]
            words, gender = old[len(head) :].split(" "), own[0][0]
            new = head + " ".join(w if w in PARTICLES else cased(w, names["surname" if k == len(words) - 1 else gender, w.lower()]) for k, w in enumerate(words))
        elif kind in ("email", "ip") or kind == "secret" and not re.match("(sk|pk|ghp|key)[-_]", old):
            new = names[own[0]].upper() if old.upper() == old != old.lower() else names[own[0]]
        elif kind == "secret":
            new = names[own[0]]
        elif kind:
            plain = [c for c in old if c.isascii() and c.isalnum()]
            letters = iter(plain[: len(plain) - len(names[own[0]])] + list(names[own[0]]))
            new = "".join(next(letters) if c.isascii() and c.isalnum() else c for c in old)
        else:
            w, after = old.lower(), found[i + 1] if i + 1 < len(found) else None
            if w in given and after and after[0].lower() in surnames and text[m.end() : after.start()] == " ":
                new = cased(old, given[w])
            elif w in surnames:
                new = cased(old, surnames[w])
        out += text[at : m.start()] + (old if new is None else new)
        at, n = m.end(), n + (new is not None)
    return out + text[at:], n


TEXTS = [
    "Mr. John Smith came. Smith left, said John Smith. John stayed; SMITH'S hat and Smithson's coat. Yesterday Smith slept.",
    "Herr Smith met Frau Anna Miller-Jones. Anna Miller-Jones wrote to a@b.example and A@B.EXAMPLE. Miller-Jones's file.",
    "Smith without a title stays, like Anna. IBAN DE89 3704 0044 0532 0130 00, card 4111-1111-1111-1111.",
    "Госпожа Анна Петрова ушла. Петрова молчала. Κύριος Νίκος Παπάς: Παπάς. DE89370400440532013000 GB00WEST12345698765432",
    "Dr. John Smith met Mr. John Smith and MR SMITH; mr. Jan van der Berg, Frau Dos Santos. Van der Berg, Berg, Jan Berg.", "Prof. Kim Lee, Dr. Sam Low", "Ms Kim Park; Dr. Kim Lee", "Mr Sam Park",
    "sk_AbCdEfGhIjKlMnOp sk_aBcDeFgHiJkLmNoP ghp_" + "aB3" * 60 + " 564-555-4526 +44 20 7946 0958, 0123456789ABCDEF0123456789ABCDEF",
    "Call +1 (564) 555-4526 or 10.0.0.1; key-0123456789abcdef0123 " + "0123456789abcdef" * 2, "nothing here", "",
]


def test_against_one_mention_after_the_other(spark):
    sf = "/root/testdata/sf0.001"
    texts = [*TEXTS, *(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect())]
    kinds = resolved(texts)
    found = {e for own in kinds for e in own.values()}
    names = {(r.kind, r.canon): r.surrogate for r in pii.dictionary(spark.createDataFrame(sorted(found), "kind string, canon string"), "k").collect()}
    space = lambda k: k[:5]  # noqa: E731  given names of all genders are distinct
    assert names.keys() == found and len({(space(k), v) for (k, _), v in names.items()}) == len(names) and not {(space(k), v) for (k, _), v in names.items()} & {(space(k), c) for k, c in found}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.surrogates(docs, "k").collect()}
    assert got == {i: brute(t, {e: names[of] for e, of in own.items()}) for i, (t, own) in enumerate(zip(texts, kinds))}
    assert "Smith" not in got[0][0].replace("Smithson", "") and got[0][0].count("John") == 1 and got[2][0].startswith("Smith without") and got[len(TEXTS) - 2] == ("nothing here", 0)


def test_accounts_keep_valid_check_digits(spark):
    def rest(x):
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97

    old = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "DE00370400440532013000"]
    got = {r.canon: r.surrogate for r in pii.dictionary(spark.createDataFrame([("iban", x) for x in old], "kind string, canon string"), "k").collect()}
    assert [rest(got[x]) == 1 for x in old] == [rest(x) == 1 for x in old] == [True, True, True, False]
    assert all(got[x][:2] == x[:2] and len(got[x]) == len(x) and [c.isdigit() for c in got[x]] == [c.isdigit() for c in x] for x in old)


def test_odd_rows_and_plan(spark):
    rows = [(1, None), (2, ""), (3, "a@b.example"), (3, "a@b.example"), (3, "c@d.example"), (None, "x@y.example"), (7, "word " * 100_000 + "a@b.example")]
    docs = spark.createDataFrame([(i, t, len(t or ""), "k", "n") for i, t in rows], "doc_id bigint, text string, n_chars bigint, kind string, names string")
    got = pii.surrogates(docs, "k")
    assert got.columns == [*docs.columns, "n_entities"] and got.count() == len(rows) and got.where("n_entities > 0").count() == 5
    mails = got.where("doc_id = 3").select("text").collect()
    assert len({r.text for r in mails}) == 2 and got.where(F.col("n_chars") != F.length("text")).count() == 0
    assert pii.surrogates(docs.limit(0), "k").count() == 0
    clash = docs.selectExpr("doc_id", "text", "7 as n_entities", "'r' as row", "'d' as doc", "1 as tie", "'m' as mentions", "1 as new")
    both = pii.surrogates(clash, "k")
    assert both.columns == ["doc_id", "text", "row", "doc", "tie", "mentions", "new", "n_entities"] and both.where("n_entities > 0 and row = 'r'").count() == 5
    assert pii.surrogates(clash, "k", count_col=None).columns == clash.columns
    assert not any(x in got._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))


def test_names_have_no_ceiling(spark):
    scripts = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("p")) for k, p in (("surname", "ж"), ("surname", "ξ"), ("given_f", "ξ")))))
    found = spark.range(25_000).select("id", scripts.alias("e")).select("e.kind", F.concat("e.p", F.col("id").cast("string")).alias("canon"))
    got = pii.dictionary(found, "k").cache()
    assert got.count() == got.select("kind", "surrogate").distinct().count() == 75_000
    assert got.where(F.col("surrogate").rlike("[0-9]") | F.col("surrogate").isNull()).count() == 0


def test_secrets_keep_case_length_and_prefix(spark):
    """Two secrets that differ by case are two; what comes out is a secret of the same length, character by character of the same kind."""
    old = ["sk_AbCdEfGhIjKlMnOp", "sk_aBcDeFgHiJkLmNoP", "ghp_" + "aB3" * 53, "key-" + "Z" * 5000, "0123456789abcdef" * 2, "0123456789ABCDEF" * 3]
    new = [t.split(" ")[1] for t in run(spark, [f"use {x} now" for x in old])]
    assert len(set(new)) == len(old) and not set(new) & set(old)
    kind = lambda x: "".join("0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in x)
    for a, b in zip(old, new):
        start = re.match("(sk|pk|ghp|key)[-_]|", a)[0]
        assert b.startswith(start) and kind(a[len(start) :]) == kind(b[len(start) :]) or not start and len(a) == len(b) and a.isupper() == b.isupper()
        assert regex.fullmatch(pii.PATTERNS["secret"], b)


def test_a_person_has_one_name_and_a_number_one_surrogate(spark):
    a, b, c = run(spark, ["Dr. John Smith met Mr. John Smith. Ms Kim Park and Mr Kim Lee.", "Call +1 (564) 555-4526, 564-555-4526, +44 564 555 4526.", "Dr. John Miller"])
    m = re.fullmatch(r"Dr\. (\w+ \w+) met Mr\. (\w+ \w+)\. Ms (\w+) \w+ and Mr (\w+) \w+\.", a)
    assert m and m[1] == m[2] and m[3] != m[4] and m[3].lower() in pii.GIVEN["latin", "f"] and c.split(" ")[1] == m[1].split(" ")[0]
    n = re.fullmatch(r"Call \+1 \((\d{3})\) (\d{3}-\d{4}), (\d{3})-(\d{3}-\d{4}), \+44 (\d{3}) (\d{3}) (\d{4})\.", b)
    assert n and (n[1], n[2]) == (n[3], n[4]) == (n[5], f"{n[6]}-{n[7]}") != ("564", "555-4526")


def test_given_names_are_distinct_over_all_genders(spark):
    names = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    found = spark.createDataFrame([(f"given_{g}", n) for n in names for g in "mfn"], "kind string, canon string")
    rows = pii.dictionary(found, "k").collect()
    assert len({r.surrogate for r in rows}) == len(rows) == 3 * len(names)


def test_titles_of_any_case_middle_names_and_particles(spark):
    a, b = run(spark, ["MR SMITH and mr. Smith", "Mr. John Ronald Kennedy; Herr Jan van der Berg; Doña Maria de la Cruz"])
    m = re.fullmatch(r"MR ([A-Z]+) and mr\. (\w+)", a)
    assert m and m[1] == m[2].upper() != "SMITH"
    n = re.fullmatch(r"Mr\. (\w+) (\w+) (\w+); Herr (\w+) van der (\w+); Doña (\w+) de la (\w+)", b)
    assert n and not set(n.groups()) & {"John", "Ronald", "Kennedy", "Jan", "Berg", "Maria", "Cruz"}
