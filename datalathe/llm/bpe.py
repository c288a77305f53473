"""Byte-pair encoding and decoding of whole texts, cut at byte pairs no token contains.

A merge joins two neighbours into a token, so where two neighbouring bytes occur together
inside no token of the vocabulary, no merge ever crosses them: the cut is certain, and what
stands on both sides can be encoded on its own. The pre-tokenizer must agree. Between a
character that is not white space and one that is, its pattern always ends a match, and
neither side's matches depend on the other. So texts are cut where both hold; with a
byte-level vocabulary that is before nearly every space.

Fragments are short and repeat, so each worker keeps those it has met (a bounded memo of two
generations); the tokenizer's own model encodes only new ones. Concatenating the fragments' ids
gives exactly the ids of the whole text, at any length and in bounded memory.

Null texts encode as empty ones. Other columns of the input pass through untouched; an output
name that the input already has is an error. Equal rows give equal rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from datalathe.llm.common import gather, map_arrow, payloads, sliced, with_fields

#: A worker's memo starts a new generation beyond this many fragments, and never keeps longer ones than this.
MEMO_FRAGMENTS, MEMO_LENGTH = 400_000, 64
#: Texts are cut and looked up in stretches of about this many bytes.
STRETCH = 1 << 20

_WORDS = re.compile(rb"\s*\S+|\s+")
#: A line break, a word of Latin letters with its space, and punctuation are three pre-tokens at most.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"\n?(?: ?[{_LETTERS}]+)[{_MARKS}]*")
_PIECE = rf"\n| ?[{_LETTERS}]+|[{_MARKS}]+"


def _is_space(byte: int) -> bool:
    return byte == 32 or 9 <= byte <= 13


def byte_alphabet() -> dict[str, int]:
    """The byte each printable stand-in of a byte-level vocabulary means.

    Printable Latin-1 bytes stand for themselves; the others take the characters from 256 on, in order.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def forced_pairs(tokens: list[bytes]) -> np.ndarray:
    """256 x 256 flags: True where the two bytes stand side by side inside no token."""
    joined = np.frombuffer(b"".join(tokens), np.uint8)
    inside = np.ones(max(len(joined) - 1, 0), bool)
    ends = np.cumsum([len(t) for t in tokens])[:-1]
    ends = ends[(ends > 0) & (ends < len(joined))]
    inside[ends - 1] = False
    forced = np.ones((256, 256), bool)
    forced[joined[:-1][inside], joined[1:][inside]] = False
    return forced


class _Memo(dict):
    """Fragments and their ids in two generations: what the younger lacks moves up from the older or is made."""

    def __init__(self, make, older: dict | None = None):
        self.make, self.older = make, older or {}

    def __missing__(self, fragment: bytes) -> bytes:
        ids = self.older.get(fragment)
        if ids is None:
            ids = self.make(fragment)
        if len(fragment) <= MEMO_LENGTH:
            self[fragment] = ids
        return ids


class Codec:
    """Encoder and decoder of one byte-level BPE tokenizer file."""

    def __init__(self, path: str, memo: int | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel"
        if not plain or before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("dropout"):
            raise ValueError("only byte-level BPE without normaliser, added space or dropout is supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take neighbouring characters are not supported")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alphabet = byte_alphabet()
        tokens = {i: bytes(alphabet[c] for c in t) for t, i in model["vocab"].items() if set(t) <= alphabet.keys()}
        self.forced = forced_pairs(list(tokens.values()))
        self._quick = self._merger(tokens, model)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        tokens |= {i: t for t, i in self.special.items()}
        self._special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len)[::-1])) + b")")
        self.size = max(tokens) + 1
        table = [tokens.get(i, b"") for i in range(self.size)]
        self.bytes_of = _packed(table)
        self.digits_of = _packed([b",%d" % i for i in range(self.size)])
        self._most = memo
        self._memo, self._words = _Memo(self._fragment), _Memo(self._word)
        unsure = [bytes((a, b)) for b in (10, 32) for a in range(256) if not self.forced[a, b] and not _is_space(a)]
        # White space before white space, characters that may be white space, pairs that are not forced.
        tests = [rb"[\t-\r ][ \n]", rb"[\xc2\xe0-\xf7][\x80-\xbf]{1,3}[ \n]", *map(re.escape, unsure)]
        self._unsure = re.compile(b"|".join(tests))

    def cuts(self, data: bytes) -> np.ndarray:
        """Byte offsets at which the text is cut."""
        raw = np.frombuffer(data, np.uint8)
        space = ((raw - np.uint8(9)) <= 4) | (raw == 32)
        at = np.flatnonzero(space[1:] & ~space[:-1])
        sure = self.forced[raw[at], raw[at + 1]]
        # After a longer character: two-byte characters from U+00C0 on are never white space, others may be.
        lead = raw[np.maximum(at - 1, 0)]
        sure &= (raw[at] < 0x80) | ((lead >= 0xC3) & (lead <= 0xDF))
        self._all_sure = bool(sure.all())
        return at[sure] + 1

    def encode(self, data: bytes) -> np.ndarray:
        """Ids of a whole text as uint32."""
        parts: list[bytes] = []
        for segment in self._special.split(data) if self.special else [data]:
            if segment in self.special:
                parts.append(np.uint32(self.special[segment]).tobytes())
            elif segment:
                parts += self._encode_segment(segment)
        return np.frombuffer(b"".join(parts), np.uint32)

    def _encode_segment(self, segment: bytes) -> Iterator[bytes]:
        if len(segment) <= STRETCH and not _is_space(segment[0]) and segment[-1] != 32 and not self._unsure.search(segment):
            # Every space and line break is a certain cut here: split there, and know words without their space.
            first, *words = segment.replace(b"\n", b" \n").split(b" ")
            yield self._look_up([first])
            yield b"".join(map(self._words.__getitem__, words))
            if len(self._words) > (self._most or MEMO_FRAGMENTS):
                self._words.older = {}
                self._words = _Memo(self._word, self._words)
            return
        at = self.cuts(segment)
        if self._all_sure and len(segment) <= STRETCH:
            yield self._look_up(_WORDS.findall(segment))
            return
        # Stretches end at cuts, so a very long text is never held as fragments at once.
        bounds = np.concatenate([[0], at, [len(segment)]])
        ends = np.searchsorted(bounds, np.arange(STRETCH, len(segment) + STRETCH, STRETCH))
        start = 0
        for end in np.unique(np.minimum(ends, len(bounds) - 1)).tolist():
            if end > start:
                stretch = bounds[start : end + 1].tolist()
                yield self._look_up([segment[i:j] for i, j in zip(stretch, stretch[1:])])
                start = end

    def _look_up(self, fragments: list[bytes]) -> bytes:
        found = b"".join(map(self._memo.__getitem__, fragments))
        if len(self._memo) > (self._most or MEMO_FRAGMENTS):
            self._memo.older = {}
            self._memo = _Memo(self._fragment, self._memo)
        return found

    def _word(self, word: bytes) -> bytes:
        """Ids of a word after a space, or of one with its line break."""
        return self._fragment(word if word[:1] == b"\n" else b" " + word)

    def _fragment(self, fragment: bytes) -> bytes:
        """Ids of a fragment the memo lacks."""
        text = fragment.decode()
        if self._quick and _PLAIN.fullmatch(text):
            return array("I", self._quick.encode_ordinary(text)).tobytes()
        # Whatever else the pre-tokenizer splits, it splits itself.
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merger(self, tokens: dict[int, bytes], model: dict):
        """A faster merge loop for plain fragments, where it is sure to give the same ids.

        It merges the neighbours whose union is the token of lowest id; the model merges those that its
        list pairs, in list order. Both agree when ids follow the list and every token's own bytes encode
        to that token: inside a union no merge has crossed its ends, so its parts are those that its bytes
        alone would have by then, and for a token that encodes to itself these are the listed pair.
        """
        import tiktoken

        made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        own = self.tokenizer.model.tokenize
        ordered = None not in made and all(a < b for a, b in zip(made, made[1:]))
        ranks = {t: i for i, t in tokens.items()}
        if not ordered or len(ranks) < len(tokens) or not all(bytes([b]) in ranks for b in range(256)):
            return None
        if any([t.id for t in own(token)] != [i] for token, i in model["vocab"].items() if i in tokens):
            return None
        return tiktoken.Encoding("plain", pat_str=_PIECE, mergeable_ranks=ranks, special_tokens={})

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text the ids stand for; broken sequences become U+FFFD."""
        joined = b"".join(gather(*self.bytes_of, part).tobytes() for part in _parts(ids))
        return joined.decode("utf-8", "replace").encode("utf-8")

    def decimal(self, ids: np.ndarray) -> Iterator[bytes]:
        """The ids as decimal numbers joined by commas, in parts."""
        for i, part in enumerate(_parts(ids)):
            text = gather(*self.digits_of, part).tobytes()
            yield text if i else text[1:]


def _packed(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in items], np.int64)
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum(lengths) - lengths, lengths


def _parts(ids: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(0, len(ids), STRETCH // 4):
        yield ids[i : i + STRETCH // 4]


@lru_cache(maxsize=4)
def codec(path: str, memo: int | None = None) -> Codec:
    """One codec per worker process, file and size of its memo; the work is already spread by Spark."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(path, memo)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The input with the ids of its text as an array column."""
    def work(batches):
        coder = codec(path)
        for part in sliced(batches):
            columns = {n: part.column(n) for n in part.schema.names}
            yield columns | {ids: [coder.encode(t).tolist() for t in payloads(part.column(text))]}

    return map_arrow(df, work, with_fields(df.schema, f"{ids} array<int>"))


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256, by encoding and decoding."""

    def work(batches):
        coder = codec(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for data in payloads(batch.column("__text")):
                ids = coder.encode(data)
                digest = hashlib.sha256()
                for part in coder.decimal(ids):
                    digest.update(part)
                counts.append(len(ids))
                of_ids.append(digest.hexdigest())
                of_text.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield {key: batch.column(key), "n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_text}

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text"))
    return map_arrow(rows, work, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
