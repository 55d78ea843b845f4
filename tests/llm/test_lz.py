import hashlib

import numpy as np

from pitchlake.llm import lz, queries


def phrases(text):
    seen, out, w = set(), [], ""
    for c in text:
        w += c
        if w not in seen:
            seen.add(w)
            out.append(w)
            w = ""
    return out + ([w] if w else [])


def test_a_shared_head_parses_as_the_whole():
    for text in ("", "a", "abababab" * 9, "the cat the hat the bat"):
        for cut in (0, len(text) // 3, len(text)):
            assert lz.parse(text[:cut], [text[cut:], "zz"]) == [[len(p) for p in phrases(t)] for t in (text, text[:cut] + "zz")]


def test_likeness_follows_the_jaccard_likeness_of_phrases():
    a, b = "abracadabra simsalabim " * 30 + "x" * 50, "abracadabra simsalabim " * 25 + "hocus pocus " * 12
    x, y = set(phrases(a)), set(phrases(b))
    s = lz.Signer().sign([(t, lz.parse(t, [""])[0]) for t in (a, b)])
    assert abs(lz.likeness(s[:1], s[1:])[0] - len(x & y) / len(x | y)) < 0.15


M64 = (1 << 64) - 1


def scrambled(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def brute_sign(text):
    """128 minima over the hashes of the distinct phrases, one phrase after the other."""
    if not text:
        return [0xFFFF] * 128
    hashes = []
    for p in set(phrases(text)):
        h, power = 0, 1
        for c in p:
            h = (h + scrambled(ord(c) + 1) * power) & M64
            power = power * lz.BASE & M64
        hashes.append(scrambled(h) >> 32)
    own = np.array(hashes, np.uint64)
    least = [int(((own ^ np.uint64(x)) * np.uint64(m) & np.uint64(0xFFFFFFFF)).min()) for x, m in zip(lz.MIX_XOR.tolist(), lz.MIX_MUL.tolist())]
    return [(v * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for v in least]


def brute_likeness(a, b):
    equal = sum(x == y for x, y in zip(a, b)) / 128
    return 1.0 if equal == 1 else max(0.0, (equal - 2**-16) / (1 - 2**-16))


def brute(rows):
    rows = sorted(rows, key=lambda r: r[0])
    signs, out = [brute_sign(t) for _, t in rows], {}
    hexed = lambda s: "".join(f"{x:04x}" for x in s)
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        e = t[: len(t) - cut] + n[:cut]
        own, changed, after = signs[k], brute_sign(e), signs[(k + 1) % len(rows)]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), hexed(own), hexed(changed), round(brute_likeness(own, changed), 9), round(brute_likeness(own, after), 9))
    return out


def got(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op1_lz_fingerprints(spark, sf)) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, "x" * 200_000), (1, None), (9, "ab"), (2, ""), (7, "naïve 😀 text " * 9)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, run int, guest int")
    assert got(lz.with_edits(docs)) == brute([(i, t or "") for i, t in rows])
    assert lz.with_edits(docs.limit(0)).count() == 0
    assert got(lz.with_edits(docs.where("doc_id = 7"))) == brute([(7, rows[-1][1])])
    twice = lz.with_edits(docs.union(docs)).collect()
    assert len(twice) == 10 and all(np.isfinite(r.near_next) for r in twice)
    nameless = docs.union(docs.selectExpr("cast(null as bigint)", "text", "run", "guest"))
    assert sorted(r.doc_id or 0 for r in lz.with_edits(nameless, runs=3).collect()) == [0] * 5 + [1, 2, 5, 7, 9]
    assert len({r.fingerprint for r in lz.fingerprint(docs.union(docs)).collect()}) == 4


def test_rows_of_one_id_fill_several_runs(spark):
    rows = [(None if i % 3 else 7, f"text of the row number {i} " * (1 + i % 4)) for i in range(300)]
    docs = spark.createDataFrame(rows + rows[:1] * 50, "doc_id bigint, text string")
    keys = docs.selectExpr("coalesce(doc_id, -9223372036854775808) as doc_id", "xxhash64(text) as tie")
    cuts = lz.range_cuts(keys, 8)
    every = np.array([tuple(r) for r in keys.collect()])
    sizes = np.bincount(lz.run_of([every[:, 0], every[:, 1]], cuts))
    assert len(sizes) == 8 and sizes.max() < 130
    order = np.lexsort((every[:, 1], every[:, 0]))
    assert (np.diff(lz.run_of([every[order, 0], every[order, 1]], cuts)) >= 0).all()
    one, other = (sorted((str(r.doc_id), r.edited_sha256, r.near_next) for r in lz.with_edits(docs, runs=n).collect()) for n in (1, 8))
    assert one == other and len(one) == 350
