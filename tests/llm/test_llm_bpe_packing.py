import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from datalathe.llm import bpe, packing
from datalathe.llm.queries import byte_bpe


@pytest.fixture(scope="module")
def coder():
    return bpe.codec(byte_bpe())


def test_encoding_equals_the_library_on_awkward_texts(coder):
    rnd = random.Random(2)
    alphabet = [
        "a", "the", "'s", "'re", "don't", " ", "  ", "\n", "\r\n", "\t", " ", " ", "　", "\x1c", "\x85", "﻿", "​",
        "é", "É", "ß", "你", "好", "0", "9", "٣", "²", "!", "...", "'", "<|endoftext|>", "🙂", "̀", "𐐷", "_", "-",
    ]
    for _ in range(4000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14)))
        ids = coder.tokenizer.encode(text, add_special_tokens=False).ids
        found = coder.encode(text.encode())
        assert found.tolist() == ids, repr(text)
        assert coder.decode(found).decode() == coder.tokenizer.decode(ids, skip_special_tokens=False), repr(text)
        assert b"".join(coder.decimal(found)).decode() == ",".join(map(str, ids))


def test_cuts_are_at_forced_pairs_only(coder):
    text = "One two,\n three   four　 five été 好 six".encode()
    cuts = coder.cuts(text).tolist()
    assert cuts and all(coder.forced[text[at - 1], text[at]] for at in cuts)
    parts = [text[i:j].decode() for i, j in zip([0, *cuts], [*cuts, len(text)])]
    alone = [i for p in parts for i in coder.tokenizer.encode(p, add_special_tokens=False).ids]
    assert alone == coder.tokenizer.encode(text.decode(), add_special_tokens=False).ids


def test_stretches_and_memo_do_not_change_ids(coder, monkeypatch):
    text = ("Some words, été and  more\n\n  of them <|endoftext|> " * 400).encode()
    whole = coder.encode(text).tolist()
    monkeypatch.setattr(bpe, "STRETCH", 1000)
    monkeypatch.setattr(bpe, "MEMO_FRAGMENTS", 5)
    assert coder.encode(text).tolist() == whole
    assert coder.decode(np.array(whole, np.uint32)) == text


def test_a_smaller_memo_holds_fewer_fragments_and_gives_the_same_ids(coder):
    small = bpe.codec(byte_bpe(), 5)
    text = " ".join(f"word{i}" for i in range(300)).encode()
    assert coder is not small and [small.encode(text).tolist() for _ in range(3)] == [coder.encode(text).tolist()] * 3
    for i in range(100):
        small.encode(f"a{i} b{i} c{i}".encode())
    assert len(small._words) <= 7 and len(small._words.older) <= 7


def test_the_quick_merges_equal_the_model(coder):
    assert coder._quick is not None
    rnd = random.Random(4)
    for _ in range(3000):
        word = "".join(rnd.choice("etaoinshrdluéèß") for _ in range(rnd.randint(1, 30)))
        assert coder.tokenizer.encode(" " + word).ids == coder._quick.encode_ordinary(" " + word)


def test_digests_and_arrays_of_all_rows(corpus, nothing, coder):
    found = bpe.digests(corpus, byte_bpe())
    expected = []
    for row in corpus.collect():
        ids = coder.tokenizer.encode(row["text"] or "", add_special_tokens=False).ids
        decoded = coder.tokenizer.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((row["doc_id"], len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)
    assert bpe.digests(nothing, byte_bpe()).count() == 0
    encoded = bpe.encode(corpus.where("doc_id = 31"), byte_bpe())
    assert encoded.columns == [*corpus.columns, "ids"]
    with pytest.raises(ValueError):
        bpe.encode(corpus.withColumnRenamed("n_chars", "ids"), byte_bpe())


def test_schedule_equals_serving_the_quanta_one_by_one():
    rnd = random.Random(3)
    for trial in range(150):
        window, quantum = rnd.choice([16, 32]), rnd.choice([4, 8])
        totals = {q - 1: rnd.randint(1, rnd.choice([5, 100, 400])) for q in range(rnd.randint(1, 5))}
        weights = None if trial % 2 else {q: rnd.randint(1, 9) for q in totals}
        schedule = packing.Schedule(totals, weights, window, quantum)
        sequences = {}
        for queue, total in totals.items():
            cuts = np.array(sorted({0, total, *(rnd.randint(0, total) for _ in range(5))}))
            seen = []
            for stretch, start, length, sequence, offset in zip(*(v.tolist() for v in schedule.place(queue, cuts[:-1], np.diff(cuts)))):
                seen += range(cuts[stretch] + start, cuts[stretch] + start + length)
                sequences.setdefault(sequence, []).extend((o, queue) for o in range(offset, offset + length))
            assert sorted(seen) == list(range(total))
        served = sorted(
            (Fraction(2 * j + 1, int(schedule.weights[i])), i, q, j)
            for i, q in enumerate(schedule.queues)
            for j in range(int(schedule.quanta[i]))
        )
        expected = [q for _, _, q, j in served for _ in range(min(quantum, totals[q] - j * quantum))]
        assert [q for s in sorted(sequences) for _, q in sorted(sequences[s])] == expected
        for sequence, places in sequences.items():
            n = len(places)
            assert sorted(o for o, _ in places) == list(range(n))
            assert n == window or sequence >= sum(totals.values()) // window and n & (n - 1) == 0


def _check(pieces, rows, coder):
    ids_of = {}
    for row in rows:
        ids = [*coder.tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 1]
        ids_of.setdefault(row["doc_id"], []).append(ids)
    sequences, covered = {}, {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        covered.setdefault(p["doc_id"], []).append((p["doc_tokens"], p["start"], p["length"], p["ids_crc32"]))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        total = sum(n for _, n in places)
        assert total <= 2048 and (total == 2048 or total & (total - 1) == 0)
    for key, texts in ids_of.items():
        if len(texts) > 1 and key is None:
            continue
        parts = sorted(covered[key])
        ids = texts[0]
        assert sum(n for _, _, n, _ in parts) == len(ids) * len(texts)
        for tokens, start, length, crc in parts:
            assert tokens == len(ids)
            assert zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc


def test_packing_keeps_every_id_once(corpus, nothing, coder):
    rows = corpus.collect()
    pieces = packing.pack(corpus, byte_bpe()).collect()
    _check(pieces, rows, coder)
    assert packing.pack(nothing, byte_bpe()).count() == 0
    _check(packing.pack(corpus, byte_bpe(), targets={"src0": 3.0, "src1": 1.0}).collect(), rows, coder)


def test_windows_hold_the_target_proportions(spark):
    # One source has two thirds of all rows; small ones share a queue.
    rows = [(i, f"word{i} " * (40 + i % 30), "big" if i % 3 else f"small{i % 2}" if i % 2 else f"rare{i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    pieces = packing.pack(df, byte_bpe()).toPandas()
    full = pieces.groupby("sequence_id")["length"].transform("sum") == 2048
    share = pieces[pieces.source == "big"].length.sum() / pieces.length.sum()
    per = pieces[full & (pieces.source == "big")].groupby("sequence_id")["length"].sum() / 2048
    assert abs(per - share).max() <= 2 * packing.QUANTUM / 2048
    assert len(per) == full.groupby(pieces.sequence_id).first().sum()


def _furthest(pieces):
    """The most tokens by which a source is ahead of or behind its share after any number of windows."""
    pieces = pieces[pieces.groupby("sequence_id")["length"].transform("sum") == 2048]
    table = pieces.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
    dealt = table.cumsum()
    return abs(dealt - np.outer(np.arange(1, len(dealt) + 1) * 2048, table.sum() / table.to_numpy().sum())).to_numpy().max()


@pytest.mark.parametrize("sources, hot", [(40, 0), (19, 2000), (200, 0)])
def test_small_sources_keep_their_share_in_reading_order_of_sources(spark, coder, sources, hot):
    # Even sources, each under a quantum a window, one after the other; 200 of them need two levels.
    each = 4000 // sources if hot == 0 else 60
    rows = [(f"small{s:03d}", f"word{s} " * 60) for s in range(sources) for _ in range(each)] + [("hot", "hot words " * 60)] * hot
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string").coalesce(3)
    pieces = packing.pack(df, byte_bpe())
    _check(pieces.collect(), df.collect(), coder)
    assert _furthest(pieces.toPandas()) <= 8 * packing.QUANTUM


def test_small_sources_count_one_each_beside_targets(spark):
    rows = [("main", "word " * 60)] * 2000 + [(f"small{s}", "word " * 60) for s in range(30) for _ in range(20)]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    pieces = packing.pack(df, byte_bpe(), targets={"main": 10.0}).toPandas()
    first = pieces[pieces.sequence_id < 8]
    assert abs(first[first.source == "main"].length.sum() / first.length.sum() - 10 / 40) < 0.02
