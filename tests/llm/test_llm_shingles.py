import random

import corpus_pipeline
import numpy as np
import pytest

from datalathe.llm import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _similar(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def _lowest(rows):
    """The least doc_id of each group, by brute force over all pairs."""
    sets = [_plain_set(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and _similar(sets[a], sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    lowest = {}
    for row, g in zip(rows, group):
        if row["doc_id"] is not None:
            lowest[g] = min(lowest.get(g, row["doc_id"]), row["doc_id"])
    return set(lowest.values()), len(set(group))


def _corpus(spark):
    rnd = random.Random(21)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    common = fresh(14)
    texts = []
    for _ in range(25):
        base = fresh(rnd.choice([4, 9, 30, 120, 300])) + common
        texts.append(base)
        for _ in range(3):
            near = list(base)
            for _ in range(rnd.randint(1, max(2, len(base) // 25))):  # about the threshold, on both sides
                near[rnd.randrange(len(near))] = f"x{rnd.randrange(10**6)}"
            texts.append(near)
    step = fresh(200)  # a chain whose ends are far apart
    for i in range(12):
        step = step[8:] + fresh(8)
        texts.append(step)
    texts += [common, common[:13], fresh(3), [], common + ["tail"]]
    texts = [" ".join(t) for t in texts]
    texts += [texts[0].upper(), texts[5], None]
    rnd.shuffle(texts)
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.mark.parametrize("sample", [32, 1])
def test_the_stage_keeps_one_of_each_group_at_five_words_and_four_fifths(spark, monkeypatch, sample):
    monkeypatch.setattr(shingles, "SAMPLE", sample)  # with 1, common shingles are put last
    docs = _corpus(spark)
    lowest, groups = _lowest(docs.collect())
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    found = [r["doc_id"] for r in kept.collect()]
    assert len(found) == groups and set(found) == lowest


def test_the_stage_on_awkward_rows(spark, corpus, nothing):
    lowest, groups = _lowest(corpus.collect())
    found = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, corpus, "").collect()]
    assert len(found) == groups and set(found) == lowest
    assert corpus_pipeline.near_duplicates(spark, nothing, "").count() == 0


def test_sketches_differ_in_no_more_bits_than_the_sets_in_shingles():
    rnd = np.random.default_rng(4)
    for n in (1, 5, 64, 65, 900, 1025, 5000):
        x = np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
        for lost, new in ((0, 0), (n // 10, n // 9), (0, n // 4), (n // 5, 0), (n, n)):
            y = np.union1d(x[lost:], rnd.integers(0, 1 << 64, new, dtype=np.uint64))
            apart = len(np.setxor1d(x, y))
            found = shingles.differing_bits(shingles.sketch(x), shingles.sketch(y))
            assert found <= apart and found % 2 == apart % 2


def _letters(n, kind):
    """Texts from one template of 60 words, 0.67 to 0.84 alike: one word changed anywhere, or two names in fixed places."""
    rnd = random.Random(8)
    template = [f"t{i}" for i in range(60)]
    texts = []
    for i in range(n):
        words = list(template)
        for place in [rnd.randrange(60)] if kind == "anywhere" else [20, 40]:
            words[place] = f"n{i}p{place}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("kind", ["anywhere", "names"])
def test_pairs_of_template_families_grow_with_the_texts_not_their_square(spark, monkeypatch, kind):
    counted, verified = [], shingles._Sets.verified

    def counting(self, pairs):
        counted[-1] += pairs.count()
        return verified(self, pairs)

    monkeypatch.setattr(shingles._Sets, "verified", counting)
    for n in (300, 1200):
        counted.append(0)
        texts = _letters(n, kind)
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
        found = {r["doc_id"] for r in shingles.deduplicated(docs).collect()}
        if n == 300:
            lowest, _ = _lowest(docs.collect())
            assert found == lowest
        else:
            assert len(found) == {"anywhere": 1, "names": n}[kind]
    assert counted[1] <= 5 * counted[0] + 1000
    assert counted[1] <= 6 * 1200


def test_links_of_classes_hold_for_all_members(spark, monkeypatch):
    """With every group large, all that the first hubs leave goes through classes."""
    monkeypatch.setattr(shingles, "DIRECT", 0)
    docs = _corpus(spark)
    lowest, groups = _lowest(docs.collect())
    found = [r["doc_id"] for r in shingles.deduplicated(docs).collect()]
    assert len(found) == groups and set(found) == lowest


def test_golay_keys_of_fingerprints_find_near_copies_before_the_prefix_filter(spark, monkeypatch):
    rnd = random.Random(3)
    texts = []
    for _ in range(30):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    texts += [texts[0], "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    monkeypatch.setattr(shingles, "_near", lambda sets: spark.createDataFrame([], "key long, node long, size int, place int"))
    prints = [shingles.simhash.majority(shingles.shingle_set(t.encode())) for t in texts[:60]]
    within = [i for i in range(0, 60, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 2]
    assert len(within) > 10
    found = {r["doc_id"] for r in shingles.deduplicated(docs).collect()}
    assert found == set(range(62)) - {i + 1 for i in within} - {60}


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_dropped_rows_joined_and_broadcast_give_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(shingles, "DROPPED", most)
    docs = _corpus(spark)
    lowest, groups = _lowest(docs.collect())
    found = [r["doc_id"] for r in shingles.deduplicated(docs).collect()]
    assert len(found) == groups and set(found) == lowest
