"""Vantage-point trees, codes with adaptive bounds and automaton search against brute force."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from datalathe.llm import codebooks, lexical, vptree

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, id long, shard string"
ODD = [
    (900, None, 1), (901, [1.0, None, 2.0], 1), (902, [float("nan"), 1.0], 1), (903, [float("inf")], None), (904, [], None),
    (905, [0.0, 0.0], 3), (906, [0.5], None), (None, [1.0, 2.0], 2), (920, [3.0, -1.0, 2.0], 1), (920, [3.0, -1.0, 2.0], 1),
    (940, [3.0, -1.0, 2.0], None),
]


def _vectors(spark, n=400, size=6, seed=3, odd=ODD):
    """Clusters, copies, other lengths and odd rows; two extra columns with names the operators use."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(8, size)) * 3
    rows = [(i, (centres[i % 8] + rnd.normal(size=size) * (0.1 if i % 3 else 2)).tolist(), i % 4) for i in range(n)]
    rows += [(n + i, rows[min(5, n - 1)][1], 7) for i in range(60)] + odd
    return spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(5)


def _fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _nearest_by_brute_force(rows, queries, k):
    size = max((len(r["embedding"]) for r in rows if _fine(r["embedding"])), default=0)
    filled = lambda v: v + [0.0] * (size - len(v))
    part = lambda r: r["vec_id"] is not None and _fine(r["embedding"]) and any(r["embedding"])
    held = [(r["vec_id"], filled(r["embedding"])) for r in rows if part(r)]
    out = []
    for q in filter(part, queries):
        x = filled(q["embedding"])
        scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in held if i != q["vec_id"])[:k]
        out += [(q["vec_id"], rank + 1, i, round(-s, 9)) for rank, (s, i) in enumerate(scored)]
    return sorted(out)


def _shown(found):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found.collect())


@pytest.mark.parametrize("shape", [(16384, 128, 1024), (70, 8, 9), (1, 1, 1)])
def test_factor_one_is_exact(spark, shape):
    shard_rows, leaf_rows, block = shape
    rows = _vectors(spark, *((400,) if shard_rows > 1 else (40,)))
    queries = rows.where("vec_id % 20 = 0")
    found = vptree.nearest(rows, queries, 7, 1.0, shard_rows, leaf_rows, block)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert _shown(found) == _nearest_by_brute_force(rows.collect(), queries.collect(), 7)


def test_fewer_candidates_than_asked_for_and_nothing(spark):
    rows = _vectors(spark, 3, odd=ODD[:3])
    few = rows.where("vec_id < 3")
    assert _shown(vptree.nearest(few, few)) == _nearest_by_brute_force(few.collect(), few.collect(), 20)
    none = rows.where("vec_id < 0")
    for a, b in ((none, rows), (rows, none), (rows.where("vec_id > 899"), rows), (none, none)):
        found = vptree.nearest(a, b)
        assert found.count() == 0 and found.columns == ["query_id", "rank", "vec_id", "score"]
    with pytest.raises(ValueError):
        vptree.nearest(rows, rows, factor=0.5)
    with pytest.raises(ValueError):
        vptree.nearest(spark.createDataFrame([(1, [1e200])], "vec_id long, embedding array<double>"), few)


def _recall(found, exact):
    of = lambda rows: {(r[0], r[2]) for r in rows}
    return len(of(found) & of(exact)) / len(of(exact))


def test_recall_falls_with_the_factor_and_holds_at_the_default(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").cache()
    queries = rows.where("vec_id % 20 = 0").cache()
    at = lambda factor: _shown(vptree.nearest(rows, queries, 20, factor, 1000, 32))
    exact = _nearest_by_brute_force(rows.collect(), queries.collect(), 20)
    assert at(1.0) == exact
    assert _recall(at(vptree.FACTOR), exact) >= 0.95
    assert _recall(at(vptree.FACTOR), exact) >= _recall(at(40.0), exact) < 0.9


def test_pruning_leaves_far_clusters_unread():
    rnd = np.random.default_rng(1)
    vectors = np.repeat(rnd.normal(size=(64, 8)) * 50, 64, axis=0) + rnd.normal(size=(4096, 8))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    order, points, spans, depth, norm = vptree.build(vectors, 64)
    shard = vptree.Shard(np.arange(4096)[order], vectors[order], vectors[points], spans, depth, norm)
    *_, visited = shard.top(np.arange(4096, 4160), vectors[::64], 10, 1.0)
    assert visited < 0.3 * 64 * (1 << depth)


def _codes_by_brute_force(rows, scale=256, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if _fine(r["embedding"])]
    width = -(-max(max((len(r["embedding"]) for r in kept), default=0), 1) // parts)
    ints = [[math.floor(scale * x) for x in r["embedding"]] for r in kept]
    ints = [v + [0] * (parts * width - len(v)) for v in ints]
    order = sorted(range(len(kept)), key=lambda i: (kept[i]["vec_id"] is None, kept[i]["vec_id"] or 0, ints[i]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(ints[i], p) for i in order] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for last in [False] * rounds + [True]:
        codes = [[min(range(len(books[p])), key=lambda e: (away(cut(v, p), books[p][e]), e)) for p in range(parts)] for v in ints]
        if last:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for v, c in zip(ints, codes) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    errors = [sum(away(cut(v, p), books[p][c[p]]) for p in range(parts)) for v, c in zip(ints, codes)]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r["label"]] = by_label.get(r["label"], 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    rows = zip(kept, codes, errors)
    return sorted((str(r["vec_id"]), bytes(c).hex(), e, by_label[r["label"]], digest) for r, c, e in rows)


def _coded(found):
    names = ("code", "error", "label_error", "codebooks_sha256")
    return sorted((str(r["vec_id"]), *(r[n] for n in names)) for r in found.collect())


@pytest.mark.parametrize("settings", [{}, {"parts": 2, "entries": 30, "rounds": 5}, {"parts": 1, "entries": 3, "rounds": 0}])
def test_codes_equal_brute_force(spark, settings, monkeypatch):
    monkeypatch.setattr(codebooks, "ROWS", 50)
    rows = _vectors(spark, 300)
    found = codebooks.encode(rows, **settings)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert _coded(found) == _codes_by_brute_force(rows.collect(), **settings)


def test_codes_of_few_rows_none_and_too_large_ones(spark):
    rows = _vectors(spark, 4)
    few = rows.where("vec_id < 4")
    assert _coded(codebooks.encode(few)) == _codes_by_brute_force(few.collect())
    empty = rows.where("vec_id = 904")  # an empty vector is a vector of zeros
    assert _coded(codebooks.encode(empty)) == _codes_by_brute_force(empty.collect())
    for nothing in (rows.where("vec_id < 0"), rows.where("vec_id = 901")):
        assert codebooks.encode(nothing).count() == 0
    with pytest.raises(ValueError):
        codebooks.encode(spark.createDataFrame([(1, [1e9], 1)], "vec_id long, embedding array<double>, label int"))


def test_bounds_settle_only_what_integers_would_and_save_work():
    rnd = np.random.default_rng(7)
    book = rnd.integers(-300, 300, (64, 4))
    parts = np.concatenate([book[rnd.integers(0, 64, 3000)] + rnd.integers(-20, 20, (3000, 4)), rnd.integers(-400, 400, (500, 4))])
    state, b = codebooks.ranked(parts, book, 8), 8
    for step in (3, 1, 30, 0, 200):
        after = book + rnd.integers(-step, step + 1, book.shape)
        after[5] = after[9]  # two equal entries: the lower one takes all
        moves = np.sqrt(((after - book) ** 2).sum(1)) * (1 + 1e-12)
        *state, error, depth = codebooks.moved_on(parts, after, moves, *state[:4])
        exact = codebooks.squared(parts, after)
        assert (state[0] == exact.argmin(1)).all() and (error == exact.min(1)).all()
        low, near, outer = state[2].astype(float), state[1], state[3].astype(float)
        roots = np.sqrt(exact)
        assert (low <= np.take_along_axis(roots, near, 1)).all()
        others = np.ones_like(roots, bool)
        np.put_along_axis(others, np.column_stack([state[0], near]), False, 1)
        assert (outer <= np.where(others, roots, np.inf).min(1)).all()
        if step == 1:
            assert (depth == 0).mean() > 0.5 and (depth > b).mean() < 0.1
        b = codebooks.narrower(b, depth)
        state = codebooks._cut(state, b)
        book = after
    assert 2 <= b <= 8


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _ranked_by_brute_force(docs, items, k=50):
    read = [(r["doc_id"], w) for r in docs if (w := _terms(r["text"]))]
    n, length, df = len(read), sum(len(w) for _, w in read), {}
    for _, w in read:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked, out = {}, []
    for r in items:
        if r["item_id"] is not None:
            asked.setdefault(r["item_id"], set()).update(_terms(r["text"]))
    for item, terms in asked.items():
        scored = []
        for doc, w in read:
            m = 50 + 50 * len(w) * n // length
            score = 0
            for t in terms & set(w):
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += weight * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


ITEMS = [
    (1, "alpha4 ALPHA4 beta12, the"), (2, "épsilon3 zeta 你好"), (2, "kappa1 theta9"), (3, None), (4, " ,.- "), (5, "absent"),
    (None, "alpha4"), (6, "word x a endoftext"), (7, "1984 alpha beta gamma the iota"), (8, "word"), (9, "tail the " + "z" * 5000),
]


@pytest.mark.parametrize("settings", [{}, {"block_items": 2, "block_terms": 4, "k": 3}])
def test_search_equals_brute_force(spark, corpus, monkeypatch, settings):
    monkeypatch.setattr(lexical, "DOCUMENTS", 4)
    extra = "item_id long, text string, doc_id long, term string"
    items = spark.createDataFrame([(*r, 5, "t") for r in ITEMS], extra).repartition(3)
    docs = corpus.withColumn("term", corpus.lang).withColumn("score", corpus.n_chars)
    found = lexical.search(docs, items, **settings)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    expected = _ranked_by_brute_force(docs.collect(), items.collect(), settings.get("k", 50))
    assert len(expected) > 10
    assert sorted(map(tuple, found.collect()), key=str) == expected


def test_search_of_nothing(spark, corpus, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for docs, asked in ((nothing, items), (corpus, items.limit(0)), (nothing, items.limit(0)), (corpus.where("text IS NULL"), items)):
        found = lexical.search(docs, asked)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_many_ties_keep_the_smallest_ids(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'same words here' as text").repartition(7)
    items = spark.createDataFrame([(1, "same"), (2, "words other")], "item_id long, text string")
    other = docs.unionByName(spark.createDataFrame([(9000 + i, "nothing") for i in range(6000)], "doc_id long, text string"))
    found = lexical.search(other, items).collect()
    assert sorted((r["item_id"], r["rank"], r["doc_id"]) for r in found) == [(i, n + 1, n) for i in (1, 2) for n in range(50)]


def test_best_drops_only_what_cannot_be_among_the_best():
    rnd = random.Random(4)
    best, rows = lexical.Best(3, 5), []
    best.held = 10_000 + 4 * 3 * 5  # cut at every step
    for doc in rnd.sample(range(2000), 2000):
        row = (rnd.randrange(3), rnd.randint(1, 9), rnd.randrange(2), doc)
        rows.append(row)
        best.held += 10_100
        best.add(*(np.array([x]) for x in row))
    expected = [r for i in range(3) for r in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[1], r[2], r[3]))[:5]]
    assert [*zip(*(c.tolist() for c in best.cut()))] == expected


def test_exact_search_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    expected = db.execute(
        """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id,
        list_dot_product(q.v, c.v) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 9)
        FROM s QUALIFY rank <= 20 ORDER BY ALL"""
    ).fetchall()
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    assert _shown(vptree.nearest(rows, rows.where("vec_id % 20 = 0"), factor=1.0, leaf_rows=16)) == expected
