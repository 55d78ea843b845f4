import random
import re
from collections import Counter

import numpy as np
import xxhash

from pitchlake.llm import queries, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps):
    """fps: {doc_id: fingerprint}; {doc_id: least reachable doc_id}."""
    out = {i: i for i in fps}
    values = np.array(list(fps.values()), np.uint64)
    ids = list(fps)
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= 3) for v in values]
    changed = True
    while changed:
        changed = False
        for k, i in enumerate(ids):
            low = min(out[ids[j]] for j in near[k])
            for j in near[k]:
                if out[ids[j]] != low:
                    out[ids[j]], changed = low, True
    return out


def clustered(n, seed):
    """Fingerprints, many of them close together."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice((1, 1, 4, 60))):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            out.append(x)
    return out[:n]


def test_codes_are_perfect():
    for code, sizes in ((simhash.GOLAY, [2048, 8855, 33649]), (simhash.HAMMING, [16, 105, 455])):
        assert [len(p) for p, _ in simhash.errors(code)] == sizes and (np.diff(simhash.errors(code)[0][1]) == 1).all()


def test_near_pairs_share_an_anchor():
    fps = np.array([x - (1 << 63) for x in clustered(400, 5)], np.int64)
    of, word, excess = simhash.anchors(fps)
    by = {}
    for o, w, e in zip(of.tolist(), word.tolist(), excess.tolist()):
        by.setdefault(o, {})[w] = e
    for a in range(len(fps)):
        for b in range(a):
            if simhash.linked(fps[a : a + 1], fps[b : b + 1])[0]:
                assert any(min(e, by[b][w]) <= 1 for w, e in by[a].items() if w in by[b])


def test_links_connect_all_with_and_without_split_groups(spark):
    fps = dict(enumerate(clustered(700, 7)))
    signed = {i: (x if x < 1 << 63 else x - (1 << 64)) for i, x in fps.items()}
    expected = brute_components(fps)
    frame = spark.createDataFrame([(x,) for x in set(signed.values())], "fp bigint")
    for group in (simhash.GROUP, 10, 100, 200):
        roots = {r.v: r.root for r in simhash.components(simhash.links(frame, group)).collect()}
        classes = Counter((expected[i], roots.get(x, x)) for i, x in signed.items())
        assert len(classes) == len({c for c, _ in classes}) == len({r for _, r in classes})


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    fps = {r.doc_id: brute_fingerprint(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    expected = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash_anchors(spark, sf).collect()}
    assert got == {i: (f"{x:016x}", expected[i]) for i, x in fps.items()}


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (2, " \n"), (5, "One two"), (6, "ONE\ttwo"), (6, "ONE\ttwo"), (7, "É é É " * 60_000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, fp int")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (6, 5), (7, 7)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    nameless = docs.union(spark.createDataFrame([(None, "one TWO", 0), (None, "nobody else has this text here", 0)], docs.schema))
    assert Counter(r.component_id for r in simhash.near_duplicates(nameless).where("doc_id is null").collect()) == Counter([5, None])


def test_components_of_a_path_and_a_star(spark):
    from pitchlake.llm.components import components

    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7)]
    got = {r.v: r.root for r in components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
