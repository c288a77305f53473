"""License scans by an exact set-similarity join of text blocks with license templates.

Words are stretches of digits, a to z (A-Z in lower case) and characters from U+0080 on; line breaks separate
words like any other character. A template of n words is sought in all blocks of a quarter more than n consecutive words,
over the whole text. A block matches when it holds at least the threshold's share of the template's
distinct words, and all its marked ones.

Words of templates are ordered by the number of texts they occur in, rare ones first. A template of n
distinct words that needs m of them can only match a block that holds one of its first n - m + 1
(prefix filter), so blocks are looked at only around these. A text needs m distinct words (length filter), and
from the first common word around such a place there must be m left of both sides (positional filter). What
passes is verified block by block, so every match is found. Only the templates' own words are counted and
kept, a number their list bounds; no text moves.

Besides, fixed phrases are found wherever their words stand consecutively in the whole text, across lines.

Null and empty texts have no words, no places and score 0; very long ones are read whole; an empty table gives no rows.
Rows are judged one by one, and other columns are ignored. A key named like an output column is an error.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from datalathe.llm.common import map_arrow, payloads, with_fields

THRESHOLD, ROOM = 0.9, 1.25

#: Phrases that label a text wherever they stand.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Public license notices, and the words a match must hold.
TEMPLATES = (
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "software"),
    ("apache-2", "licensed under the apache license version 2 0", "apache"),
    ("apache-2", "you may not use this file except in compliance with the license", "compliance"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "noncommercial"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "sharealike"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license either version 3 of the license", "gnu 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work", "waived"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
)

_FOUND = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_WORD_BYTES).split()


def block_size(words: int) -> int:
    """Words of the blocks in which a template of so many is sought."""
    return math.ceil(words * ROOM - 1e-9)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]  # distinct, rare ones first
    needed: int
    marked: frozenset
    block: int


class Matcher:
    """Templates with their filters, for words ordered by the given counts."""

    def __init__(self, templates, phrases, counts: dict[bytes, int], threshold: float = THRESHOLD):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold is a share above 0")
        rank = lambda w: (counts.get(w, 0), w)
        self.templates = []
        for label, text, marked in templates:
            words = tuple(sorted(set(text.encode().split()), key=rank))
            needed = math.ceil(threshold * len(words) - 1e-9)
            self.templates.append(Template(label, words, needed, frozenset(marked.encode().split()), block_size(len(text.split()))))
        #: Prefix filter: rare word to (template, position).
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        for i, t in enumerate(self.templates):
            for position, word in enumerate(t.words[: len(t.words) - t.needed + 1]):
                self.prefixes.setdefault(word, []).append((i, position))
        self.rare = frozenset(self.prefixes)
        self.vocabulary = frozenset(w for t in self.templates for w in t.words)
        self.order = {w: rank(w) for w in self.vocabulary}
        self.phrases = []
        for phrase, label in phrases:
            words = phrase.encode().split()
            key = min(range(len(words)), key=lambda i: rank(words[i]))
            self.phrases.append((words, key, label))
        self.keys = frozenset(words[key] for words, key, _ in self.phrases)

    def matches(self, words: list[bytes]) -> dict[int, float]:
        """The templates that a block of the text matches, by number, with the best share of their words."""
        best: dict[int, float] = {}
        if self.rare.isdisjoint(words):
            return best
        distinct = len(set(words))
        for at, word in enumerate(words):
            for i, _ in self.prefixes.get(word, ()):
                t = self.templates[i]
                if distinct < t.needed or best.get(i) == 1.0:
                    continue
                start = max(0, at - t.block + 1)
                around = words[start : at + t.block]
                common = set(around).intersection(t.words)
                first = min(t.words.index(w) for w in common)
                if min(len(common), len(t.words) - first) < t.needed or not t.marked <= common:
                    continue
                share = self._best_block(t, around)
                if share > best.get(i, 0.0):
                    best[i] = share
        return best

    @staticmethod
    def _best_block(t: Template, around: list[bytes]) -> float:
        """The largest share that a block holds together with all marked words; 0 if none has enough."""
        most = 0
        wanted = frozenset(t.words)
        for start in (i for i, w in enumerate(around) if w in wanted):
            held = wanted.intersection(around[start : start + t.block])
            if len(held) > most and t.marked <= held:
                most = len(held)
        return most / len(t.words) if most >= t.needed else 0.0

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """Starts and labels of the phrases."""
        if self.keys.isdisjoint(words):
            return []
        out = []
        for phrase, key, label in self.phrases:
            at = -1
            try:
                while True:
                    at = words.index(phrase[key], at + 1)
                    start = at - key
                    if start >= 0 and words[start : start + len(phrase)] == phrase:
                        out.append((start, label))
            except ValueError:
                pass
        return out


def text_counts(df: DataFrame, vocabulary: frozenset, text: str = "text") -> DataFrame:
    """(word, texts) of the vocabulary's words over all texts."""

    def work(batches):
        for batch in batches:
            found: Counter = Counter()
            for value in payloads(batch.column("__text")):
                found.update(vocabulary.intersection(words_of(value)))
            yield {"word": [w.decode() for w in found], "texts": list(found.values())}

    counted = map_arrow(df.select(F.col(f"`{text}`").alias("__text")), work, "word string, texts long")
    return counted.groupBy("word").agg(F.sum("texts").alias("texts"))


def scan(
    df: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row: key, words, phrase places, labels and the best share of a template found (1 with a phrase)."""
    vocabulary = frozenset(w for _, t, _ in templates for w in t.encode().split()) | frozenset(
        w for p, _ in phrases for w in p.encode().split()
    )
    # As many rows as the templates have words.
    counts = {r["word"].encode(): r["texts"] for r in text_counts(df, vocabulary, text).collect()}
    matcher = Matcher(templates, phrases, counts, threshold)
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def work(batches):
        for batch in batches:
            found = [_judge(value, matcher) for value in payloads(batch.column("__text"))]
            yield {key: batch.column(key)} | dict(zip(names, map(list, zip(*found)) if found else [[]] * len(names)))

    rows = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text"))
    return map_arrow(rows, work, with_fields(rows.drop("__text").schema, _FOUND))


def _judge(data: bytes, matcher: Matcher) -> tuple:
    words = words_of(data)
    places = matcher.places(words)
    base = {label for _, label in places}
    found = matcher.matches(words)
    labels = base | {matcher.templates[i].label for i in found}
    score = 1.0 if places else max(found.values(), default=0.0)
    starts = [s for s, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), score,
    )
