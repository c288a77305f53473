"""Sharding, archives, chat and top-k."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from datalathe.llm import bitsliced, chat, sharding, warc
from datalathe.session import fresh_path


def test_ring_loads_are_bounded_and_few_rows_move():
    ring, grown = sharding.Ring(8), sharding.Ring(9)
    hashes = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 40_000)

    def placed(r, slack):
        arcs = r.arcs(hashes)
        counts = {int(a): int(n) for a, n in zip(*np.unique(arcs, return_counts=True))}
        where = np.empty(len(hashes), int)
        ends = {}
        segments = r.fill(counts, slack)
        for arc, start, shard, _ in segments:
            ends.setdefault(arc, []).append((start, shard))
        for arc, parts in ends.items():
            rows = np.flatnonzero(arcs == arc)
            for start, shard in parts:
                where[rows[start:]] = shard
        return where

    exact = np.bincount(placed(ring, 0.0), minlength=8)
    assert exact.max() - exact.min() <= 1
    a, b = placed(ring, 0.1), placed(grown, 0.1)
    assert np.bincount(a).max() <= -(-40_000 * 1.1 // 8) and np.bincount(b).max() <= -(-40_000 * 1.1 // 9)
    assert (a != b).mean() < 0.35  # a ninth must move; rehashing would move eight ninths
    # A key with a third of all rows overflows clockwise instead of filling one shard.
    counts = {3: 10_000, **{i: 20 for i in range(10, 1000)}}
    loads = np.zeros(8, int)
    for arc, start, shard, _ in (segments := ring.fill(counts)):
        later = [s for a, s, *_ in segments if a == arc and s > start]
        loads[shard] += min(later, default=counts[arc]) - start
    assert loads.sum() == sum(counts.values()) and loads.max() - loads.min() <= 1


def test_sharded_documents(corpus, nothing):
    found = sharding.documents(corpus, 8).collect()
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    assert len(found) == corpus.count()
    loads = {}
    for r in found:
        data = (texts[r["doc_id"]] or "").encode() if r["doc_id"] is not None else None
        if data is not None:
            assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert r["law"] == "rows" and r["grown_shard"] is None
        loads.setdefault(r["shard"], []).append(r["slot"])
    assert set(loads) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in loads.values())
    assert max(map(len, loads.values())) - min(map(len, loads.values())) <= 1
    assert sharding.documents(nothing, 8).count() == 0
    assert sharding.assign(corpus.select("doc_id", "lang"), 3).columns == ["doc_id", "lang", "shard", "slot"]
    with pytest.raises(ValueError):
        sharding.assign(corpus.withColumnRenamed("lang", "slot"), 3)


def _pages(spark):
    same = "<html>" + "same " * 500 + "</html>"
    rows = [(i, f"http://a/{i}", f"<html>{i} {'page ' * (i % 50)}</html>", "x") for i in range(1, 120)]
    rows += [(i, f"http://b/{i}\n", same, "x") for i in range(200, 240)] + [(90, "http://c", same, "x"), (300, None, None, "x")]
    rows += [(301, "u", "", None), (None, "nowhere", same, "x"), (400, "big", "z" * 3_000_000, "x"), (7, "http://a/7", "<html>7 page page page page page page page </html>", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, original string").repartition(3)


def test_archives_round_trip(spark):
    pages = _pages(spark)
    folder = fresh_path(spark, "warc-test")
    archives = warc.write(pages, folder)
    found = warc.read(archives, folder).collect()
    rows = pages.collect()
    payloads = {}
    for r in rows:
        payloads.setdefault((r["html"] or "").encode(), []).append(r["page_id"])
    expected = []
    for r in rows:
        data = (r["html"] or "").encode()
        least = min((p for p in payloads[data] if p is not None), default=None)
        revisit = r["page_id"] != least and len(payloads[data]) > 1
        expected.append((str(r["page_id"]), len(data), warc.digest(data), "revisit" if revisit else "response", str(least) if revisit else "None"))
    got = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in found]
    assert sorted(got) == sorted(expected)
    # Each archive on its own: dictionary first, and every record a frame that decodes with it alone.
    store, base = warc._store(folder)
    for a in archives.collect():
        raw = store.open_input_stream(f"{base}/{a['archive']}").read()
        assert len(raw) == a["bytes"] and int.from_bytes(raw[:4], "little") == warc.SKIPPABLE_MAGIC
        records = list(warc.read_archive(io.BytesIO(raw)))
        assert len(records) == a["records"]
        for headers, block in records:
            assert headers["warc-block-digest"] == "sha1:" + warc.digest(block)
    none = warc.write(pages.where("page_id > 1000"), fresh_path(spark, "warc-test"))
    assert none.count() == 0 and warc.read(none, folder).count() == 0


def test_least_bytes_and_dictionary(spark):
    pages = _pages(spark)
    folder = fresh_path(spark, "warc-test")
    found = warc.read(warc.write(pages, folder, least_bytes=5000), folder)
    assert found.where("record_type = 'revisit'").count() == 0
    records = [warc.record(i, f"http://a/{i}", b"<html>some page about pages</html>" * (i % 5)) for i in range(500)]
    packed = b"".join(warc.archive(iter(records), 1 << 20, 4096, 3))
    alone = sum(len(__import__("zstandard").ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(packed) < alone
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(b"".join(records))))


def test_chat_reads_back_what_was_said(spark):
    rnd = random.Random(9)
    pieces = ["\\", "#", "##", "###", "</turn>", "</turn>\n", "<", "\n", ": ", "### assistant: ", "hi ", "é🙂", "$1", "\\n"]
    rows, plain = [], {}
    for conv in range(60):
        roles = rnd.choice([["user", "assistant"] * rnd.randint(1, 3), ["system", "user", "assistant"], ["assistant"], ["user", "user"], ["to:ol\\", "user"], [None, "user"]])
        turns = [(t, role, "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 8))) if rnd.random() < 0.9 else None) for t, role in enumerate(roles)]
        rows += [(conv, *t, "extra") for t in turns]
        plain[conv] = [(role or "", text or "") for _, role, text in turns]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid string").unionByName(chat.probe(spark), allowMissingColumns=True)
    plain[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    found = chat.digests(df).collect()
    assert {r["conv_id"] for r in found} == set(plain)
    segments = {r["conv_id"]: r for r in chat.segmented(df).collect()}
    for r in found:
        turns = plain[r["conv_id"]]
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(s["text"]) for s in segments[r["conv_id"]]["segments"])
        roles = [role for role, _ in turns]
        if roles[:1] == ["system"]:
            roles = roles[1:]
        pairs = list(zip(roles[::2], roles[1::2]))
        assert r["valid"] == (bool(roles) and len(roles) % 2 == 0 and set(pairs) == {("user", "assistant")})
        texts = [s["text"] for s in segments[r["conv_id"]]["segments"] if s["loss"]]
        assert len(texts) == sum(role == "assistant" for role, _ in turns)
        assert all("###" not in t and "</turn>" not in t for t in texts)


def test_chat_plan_is_native_and_odd_rows_are_defined(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, 1, "user", "b"), (1, 1, "user", "b"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat.digests(df).collect()}
    assert found[None]["n_turns"] == 1 and found[1]["n_turns"] == 3
    assert chat.digests(df.limit(0)).count() == 0
    plan = chat.digests(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _best(rows, queries, k):
    scaled = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            scaled.setdefault(i, []).append([int(np.floor(1024.0 * x)) for x in v])
    out = []
    for q in queries:
        for query in scaled.get(q, []):
            found = [(-sum(a * b for a, b in zip(query, v)), i) for i, vs in scaled.items() if i != q for v in vs]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=6) * rnd.choice([0.01, 1, 30])]) for i in range(400)]
    rows += [(400 + i, [0.25] * 6) for i in range(60)]  # ties
    rows += [(600, None), (601, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (602, [float("nan")] * 6), (603, [float("inf")] * 6), (700, [0.0] * 6), (800, [1.0, 2.0])]
    rows += [(None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    queries = [i for i, _ in rows if i is not None and i % 20 == 0]
    for options in ({}, {"block_rows": 64, "block_queries": 5, "slice_bits": 3}):
        found = bitsliced.top_k(df, df.where("vec_id % 20 = 0"), **options)
        assert sorted(tuple(r) for r in found.collect()) == _best(rows, queries, 10)
    assert bitsliced.top_k(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 4")
    assert bitsliced.top_k(few, few.where("vec_id = 0")).count() == 3
    huge = spark.createDataFrame([(0, [1e30, -1e30]), (1, [3e38, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):  # scores of such rows do not fit 64 bits
        bitsliced.top_k(huge, huge)


def test_large_components_score_exactly(spark):
    vectors = [[200.0] + [0.0] * 63, [300_000.0] + [1.5] * 63, [400_000.0] + [-2.5] * 63, [-3e9] + [0.25] * 63, [2.0**31, 7.0] + [0.0] * 62]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = bitsliced.top_k(df, df.where("vec_id = 0"), slice_bits=2)
    assert sorted(tuple(r) for r in found.collect()) == _best([*enumerate(vectors)], [0], 10)
    edge = df.where("vec_id in (1, 2)")  # the largest that may be asked
    assert sorted(tuple(r) for r in bitsliced.top_k(edge, edge).collect()) == _best([(i, vectors[i]) for i in (1, 2)], [1, 2], 10)
    with pytest.raises(ValueError):
        bitsliced.top_k(df, df)


def test_slices_add_up():
    rnd = np.random.default_rng(5)
    for _ in range(50):
        values = rnd.integers(0, 50, (rnd.integers(1, 9), 128))
        columns = [[] for _ in range(6)]
        for row in values:
            for b in range(6):
                columns[b].append(np.packbits((row >> b & 1).astype(np.uint8), bitorder="little").view(np.uint64))
        slices = bitsliced.add_slices(columns)
        total = sum(
            np.unpackbits(s.view(np.uint8), bitorder="little").astype(np.int64) << i for i, s in enumerate(slices) if s is not None
        )
        assert (total == values.sum(0)).all()
        every = np.full(2, ~np.uint64(0))
        for k in (1, 7, 128):
            bound = bitsliced.kth_largest(slices, every, k)
            assert bound == sorted(values.sum(0))[-k]
            chosen = bitsliced.at_least(slices, every, bound)
            assert np.bitwise_count(chosen).sum() == (values.sum(0) >= bound).sum()
        assert bitsliced.kth_largest(slices, every, 129) is None
