import random
import textwrap
import zlib

import numpy as np

from datalathe.llm import gam, licenses, repetition


def _longest(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            if i != j:
                k = 0
                while i + k < len(words) and j + k < len(words) and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


def test_longest_repeats_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(800):
        texts = [[rnd.randint(0, rnd.choice([0, 1, 3, 9])) for _ in range(rnd.randint(0, 14))] for _ in range(rnd.randint(1, 4))]
        symbols = np.array(sum(texts, []), np.int64)
        found = repetition.longest_repeats(symbols, np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
        assert found.tolist() == sum((_longest(t) for t in texts), [])


def _expected_quality(text):
    text = text or ""
    words = "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ")
    words = [w for w in words if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    longest = _longest(words) if len(words) < 500 else None
    def covered(least, cut=None):
        flags = [False] * len(words)
        for i, n in enumerate(longest):
            if n >= least:
                for j in range(i, i + (cut or n)):
                    flags[j] = True
        return sum(flags)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
        None if longest is None else covered(3, 3), None if longest is None else covered(10), None if longest is None else max(longest, default=0),
    )


def test_quality_counts_and_verdicts(corpus, nothing):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]
    by_text = {}
    for row in repetition.measure(corpus).collect():
        expected = _expected_quality(row["text"])
        assert all(e is None or row[n] == e for n, e in zip(names, expected)), row["doc_id"]
        by_text[row["text"]] = row
    assert by_text["word " * 3000]["longest_repeat"] == 2999
    verdicts = repetition.quality(corpus)
    assert {"doc_id", *names, "base_failed", "kept"} == set(verdicts.columns)
    for row in verdicts.collect():
        failed = row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"]
        assert row["base_failed"] == failed and not (failed and row["kept"])
    kept = repetition.filtered(corpus)
    assert kept.columns == corpus.columns and kept.count() == verdicts.where("kept").count()
    assert repetition.quality(nothing).count() == 0


def test_one_long_repeat_is_rejected_by_the_method_alone(spark):
    rnd = random.Random(3)
    fresh = lambda n: " ".join(f"w{rnd.random():.9f}" for _ in range(n))
    passage, short = fresh(51), [fresh(11) for _ in range(9)]
    spread = " ".join(f"{s} {fresh(6)}" for s in short)
    rows = [(4, f"{fresh(200)} {spread} {fresh(40)} " + " ".join(f"{s} {fresh(6)}" for s in short)), (1, f"{fresh(200)} {passage} {fresh(100)} {passage}"), (2, fresh(400)), (3, f"{fresh(300)} {fresh(12)} {fresh(20)}")]
    found = {r["doc_id"]: r for r in repetition.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not found[1]["base_failed"] and not found[1]["kept"]
    # Short passages that cover over three tenths of the words.
    assert not found[4]["base_failed"] and not found[4]["kept"] and found[4]["longest_repeat"] == 11
    assert found[2]["kept"] and found[3]["kept"]


def test_license_filters_lose_no_match():
    rnd = random.Random(7)
    vocabulary = [f"v{i}" for i in range(12)]
    for trial in range(300):
        templates = []
        for i in range(3):
            words = rnd.sample(vocabulary, rnd.randint(2, 7))
            templates.append((f"l{i}", " ".join(words), words[0] if trial % 2 else ""))
        counts = {w.encode(): rnd.randint(0, 5) for w in vocabulary}
        threshold = rnd.choice([0.5, 0.7, 0.9, 1.0])
        matcher = licenses.Matcher(templates, (), counts, threshold)
        for _ in range(10):
            text = [rnd.choice(vocabulary + ["other", "more"]).encode() for _ in range(rnd.randint(0, 30))]
            expected = {}
            for i, (_, template, marked) in enumerate(templates):
                words, size = {w.encode() for w in template.split()}, licenses.block_size(len(template.split()))
                for start in range(len(text)):
                    block = set(text[start : start + size])
                    share = len(words & block) / len(words)
                    if share >= threshold - 1e-12 and {w.encode() for w in marked.split()} <= block:
                        expected[i] = max(expected.get(i, 0), share)
            assert matcher.matches(text) == expected


def test_license_notices_are_found_across_line_breaks(spark):
    notices = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "gpl-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License",
        "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    }
    filler = " ".join(f"w{i}" for i in range(40))
    rows = [(label, f"{filler}\n" + "\n".join(textwrap.wrap(f"{filler} {text} {filler}", width))) for label, text in notices.items() for width in (20, 76)]
    rows += [("", f"{filler} Redistribution and use in {filler} source and binary forms {filler} with or without modification"), ("", None), ("", "")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    assert [r["labels"] for r in licenses.scan(df).orderBy("doc_id").collect()] == [label for label, _ in rows]


def test_license_scan(spark, corpus, nothing):
    texts = {
        1: "Released under the MIT License.",
        2: "x y\nThis work is licensed under the GNU General Public License,\nversion 3.",
        3: "This work is licensed under the GNU General Public License, version 3.",
        4: "licensed under the Apache\nLicense, Version 2.0 and CC-BY-NC",
        5: "Released under the Apache terms of a license",
        6: " ".join(f"w{i}" for i in range(90)) + " Permission is hereby granted, free of charge, to any person obtaining a copy of "
           "this software and associated documentation files " + " ".join(f"z{i}" for i in range(90)),
        7: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the conditions are met",
        8: "under the mit license under the mit license",
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, labels string")
    found = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    labels = {i: (r["base_labels"], r["labels"]) for i, r in found.items()}
    assert labels == {
        1: ("mit", "mit"), 2: ("", "gpl-3"), 3: ("", "gpl-3"), 4: ("apache-2,cc-by-nc", "apache-2,cc-by-nc"), 5: ("", ""),
        6: ("", "mit"), 7: ("", "bsd"), 8: ("mit", "mit"),
    }
    assert (found[8]["n_base"], found[8]["first_word"], found[8]["last_word"], found[8]["score"]) == (2, 0, 4, 1.0)
    assert (found[1]["n_words"], found[1]["first_word"]) == (5, 1)
    assert licenses.scan(corpus).count() == corpus.count()
    assert licenses.scan(nothing).count() == 0


def _labelled(n=900):
    rnd = random.Random(1)
    rows = []
    for i in range(n):
        good = rnd.random() < 0.7
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(20, 90))]
        kind = rnd.randrange(3)
        if not good:
            words = [[w.upper() + "!!" for w in words], [w + "###" for w in words], [w for w in words for _ in range(9)]][kind]
        rows.append((i, " ".join(words), "en", "s", 1, int(good)))
    return rows


def test_held_out_accuracy_and_score_of_every_row(spark, corpus):
    rows = _labelled()
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = gam.classify(docs, labels).collect()
    truth = {r[0]: r[5] for r in rows}
    assert len(found) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    test = [r for r in found if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in test]) > 0.97
    kept = gam.filtered(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if r["predicted"]}
    # Labels of held-out rows change nothing; awkward rows are scored; a small sample still learns.
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 0) for i, q in truth.items()], "doc_id long, quality int, toxic int")
    assert sorted(gam.classify(docs, flipped).collect()) == sorted(found)
    assert gam.classify(corpus, labels).where("score is not null").count() == corpus.count()
    few = {r["doc_id"]: r["predicted"] for r in gam.classify(docs, labels, max_rows=200).collect()}
    assert np.mean([few[i] == q for i, q in truth.items()]) > 0.9


def test_a_key_with_half_of_the_labelled_rows_trains_with_exactly_max_rows(spark, monkeypatch):
    rows = _labelled(600)
    texts = [(1 if i % 2 else r[0], r[1]) for i, r in enumerate(rows)] + [(1, "same text here") for _ in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] == 1 or not r[0] % 2], "doc_id long, quality int")
    sizes, fit = [], gam.fit
    monkeypatch.setattr(gam, "fit", lambda x, y, *a: sizes.append(len(y)) or fit(x, y, *a))
    gam.classify(docs, labels, max_rows=300).count()
    gam.classify(docs, labels, max_rows=100_000).count()
    assert sizes[0] == 300 < sizes[1]


def test_scores_equal_a_naive_sum_over_the_tables():
    rnd = np.random.default_rng(5)
    x = np.round(rnd.normal(size=(700, 4)), 1)
    model = gam.fit(x[:500], (x[:500, 0] * x[:500, 1] + x[:500, 2] > 0).astype(float))
    for row, score in zip(x.tolist(), model.score(x)):
        bin_of = lambda edges, v: sum(e <= v for e in edges)
        total = model.intercept + sum(t[bin_of(e, v)] for e, t, v in zip(model.edges, model.tables, row))
        for (a, b), t in zip(model.pairs, model.pair_tables):
            total += t[bin_of(model.pair_edges[a], row[a]), bin_of(model.pair_edges[b], row[b])]
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-12


def test_without_labels_nothing_is_learnt_or_rejected(corpus, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in gam.classify(corpus, none).collect()} == {0.5}
    assert gam.filtered(corpus, none).count() == corpus.count()
    assert gam.classify(nothing, none).count() == 0


def test_pair_tables_learn_what_single_features_cannot():
    rnd = np.random.default_rng(0)
    x = rnd.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    with_pairs, without = gam.fit(x[:3000], y[:3000]), gam.fit(x[:3000], y[:3000], pairs=0)
    accuracy = lambda m: ((m.score(x[3000:]) > 0.5) == y[3000:]).mean()
    assert accuracy(with_pairs) > 0.85 > 0.7 > accuracy(without)
    assert with_pairs.pairs[0] == (0, 1)
