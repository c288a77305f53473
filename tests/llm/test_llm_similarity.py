import random

import numpy as np
import xxhash

from datalathe.llm import simhash
from datalathe.llm.components import components


def _plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_golay_words_within_two_bits_share_an_index():
    rnd = np.random.default_rng(1)
    words = rnd.integers(0, 1 << 23, 20_000)
    flips = (1 << rnd.integers(0, 23, 20_000)) | (1 << rnd.integers(0, 23, 20_000))
    a, b = simhash.golay_indices(words), simhash.golay_indices(words ^ flips)
    assert (a[:, :, None] == b[:, None, :]).any((1, 2)).all()
    assert {len(set(r)) for r in a.tolist()} <= {1, 6}


def test_keys_meet_for_all_fingerprints_within_two_bits():
    rnd = np.random.default_rng(2)
    prints = rnd.integers(0, 1 << 64, 3000, dtype=np.uint64)
    near = prints ^ (np.uint64(1) << rnd.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 3000).astype(np.uint64))
    (r1, k1), (r2, k2) = simhash.fuzzy_keys(prints), simhash.fuzzy_keys(near)
    assert len({*zip(r1.tolist(), k1.tolist())} & {*zip(r2.tolist(), k2.tolist())}) > 0
    met = {r for r, _ in {*zip(r1.tolist(), k1.tolist())} & {*zip(r2.tolist(), k2.tolist())}}
    assert met == set(range(3000))


def _components_of(spark, prints):
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint long")
    return components(simhash.links(frame)).collect()


def test_links_equal_brute_force_in_small_and_crowded_keys(spark, monkeypatch):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for p in base[:30]:
        for _ in range(3):
            prints.add(p ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    # A crowd within a few bits of one print, and chains that leave it step by step.
    for _ in range(150):
        prints.add(base[0] ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(1, 4))}))
    step = base[1]
    for bit in range(0, 60, 2):
        step ^= 3 << bit
        prints.add(step)
    prints = sorted(prints)
    roots = _roots(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    groups = {}
    for p, r in zip(prints, roots):
        groups.setdefault(r, set()).add(p)
    expected = {frozenset(g) for g in groups.values() if len(g) > 1}
    for paired in (64, 3):
        monkeypatch.setattr(simhash, "PAIRED", paired)
        found = {}
        for node, component in _components_of(spark, prints):
            found.setdefault(component, set()).add(node & (1 << 64) - 1)
        assert {frozenset(g) for g in found.values()} == expected


def test_components_of_long_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000), (7, 7)]
    got = {(n, c) for n, c in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(301)} | {(i, 1000) for i in range(1000, 1300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_equal_brute_force(corpus, nothing):
    rows = corpus.collect()
    prints = [_plain_print(r["text"]) for r in rows]
    roots = _roots(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    lowest = {}
    for row, root in zip(rows, roots):
        if row["doc_id"] is not None:
            lowest[root] = min(lowest.get(root, row["doc_id"]), row["doc_id"])
    expected = sorted(((str(r["doc_id"]), f"{p:016x}", lowest.get(root)) for r, p, root in zip(rows, prints, roots)), key=str)
    found = simhash.near_duplicates(corpus).collect()
    assert sorted(((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in found), key=str) == expected
    kept = simhash.deduplicated(corpus)
    assert kept.columns == corpus.columns
    assert kept.count() == len(set(roots))
    assert {r["doc_id"] for r in kept.collect()} == set(lowest.values())
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.deduplicated(nothing).count() == 0
