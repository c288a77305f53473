"""WARC archives with one Zstandard frame per record and a dictionary built from the records.

An archive (``.warc.zst``) starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, as the published WARC compression format with Zstandard asks; each record follows as a
frame of its own, compressed with it. The dictionary of an archive is trained on its first records,
up to ``sample_bytes`` (a documented bound); every record is compressed with it.

Each task writes its rows to an archive of its own in the given folder, under a name no other
attempt uses. Only archives named in the returned table belong to the result, so attempts that
were lost or ran twice leave files nobody reads. Files are opened through Arrow's file systems by
their URI, so any shared store it knows will do.

Of records with equal payloads of at least ``least_bytes``, that with the smallest page id is a
response, the others are revisits that name it; rows that repeat that page id are responses too.
Null payloads are empty ones; a null page id is written without one, sorts last and is read back as
null. Line breaks in URLs are percent-encoded. Extra columns are ignored; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from datalathe.llm.common import map_arrow, utf8
from datalathe.session import cut_lineage

#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 2_000_000, 65_536, 3
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace of URLs
_DATE = "1970-01-01T00:00:00Z"
ARCHIVES = "archive string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page {page_id}' if page_id is not None else 'url ' + url)}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str = _DATE) -> bytes:
    """One WARC record: an HTTP response, or a revisit with its headers alone."""
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, url)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, url)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers_to}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on the samples; too few or too small samples give their own bytes as one."""
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def archive(records: Iterator[bytes], sample_bytes: int, dictionary_bytes: int, level: int) -> Iterator[bytes]:
    """The bytes of an archive, part by part: dictionary frame, then a frame per record."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= sample_bytes:
            break
    # A single record beyond the bound is sampled by its beginning alone.
    made = dictionary([r[:sample_bytes] for r in held], dictionary_bytes)
    yield SKIPPABLE_MAGIC.to_bytes(4, "little") + len(made).to_bytes(4, "little") + made
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(made), write_checksum=True)
    for r in chain(held, records):
        yield packer.compress(r)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed WARC stream."""
    rest = b""

    def more() -> bool:
        nonlocal rest
        got = stream.read(1 << 20)
        rest += got
        return bool(got)

    while True:
        while (end := rest.find(b"\r\n\r\n")) < 0:
            if not more():
                if rest:
                    raise ValueError("the archive ends inside a record's headers")
                return
        lines = rest[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not start with its version")
        headers = dict((k.lower(), v) for k, v in (line.split(": ", 1) for line in lines[1:]))
        rest = rest[end + 4 :]
        length = int(headers["content-length"])
        parts, have = [rest], len(rest)
        while have < length + 4:
            got = stream.read(1 << 20)
            if not got:
                raise ValueError("the archive ends inside a record")
            parts.append(got)
            have += len(got)
        rest = b"".join(parts) if len(parts) > 1 else rest
        yield headers, rest[:length]
        rest = rest[length + 4 :]


def read_archive(raw) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive opened as a binary stream."""
    head = raw.read(8)
    if len(head) < 8 or int.from_bytes(head[:4], "little") != SKIPPABLE_MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    known = zstandard.ZstdCompressionDict(raw.read(int.from_bytes(head[4:], "little")))
    unpacker = zstandard.ZstdDecompressor(dict_data=known)
    yield from parse(unpacker.stream_reader(raw, read_size=1 << 20, read_across_frames=True))


def originals(df: DataFrame, key: str, payload: str, least_bytes: int) -> DataFrame:
    """(sha, length, original) of payloads that occur more than once: the smallest key of each."""
    content = utf8(payload)
    sizes = df.select(F.sha1(content).alias("sha"), F.octet_length(content).alias("length"), F.col(f"`{key}`").alias("key"))
    sizes = sizes.where(F.col("length") >= least_bytes)
    found = sizes.groupBy("sha", "length").agg(F.min("key").alias("original"), F.count(F.lit(1)).alias("rows"))
    # Written, so that its true size decides about broadcasting.
    return cut_lineage(found.where("rows > 1").drop("rows"))


def write(
    df: DataFrame, folder: str, least_bytes: int = 0, sample_bytes: int = SAMPLE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES,
    level: int = LEVEL, key: str = "page_id", url: str = "url", payload: str = "html",
) -> DataFrame:
    """Write archives below the folder (a URI or path all executors reach) and return the table of them."""

    def work(batches):
        written = [0]

        def records():
            for batch in batches:
                columns = (batch.column(c) for c in ("key", "url", "__payload", "original", "repeated"))
                for values in zip(*columns):
                    page, address, content, original, repeated = (v.as_py() for v in values)
                    revisit = repeated and page != original
                    written[0] += 1
                    yield record(page, address, content, original if revisit else None, revisit)

        rows = records()
        first = next(rows, None)
        if first is None:
            return
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.zst"
        size = 0
        with store.open_output_stream(f"{base}/{name}") as out:
            for part in archive(chain([first], rows), sample_bytes, dictionary_bytes, level):
                out.write(part)
                size += len(part)
        yield {"archive": [name], "records": [written[0]], "bytes": [size]}

    content = utf8(payload)
    rows = df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), content.alias("__payload"),
        F.sha1(content).alias("sha"), F.octet_length(content).alias("length"),
    )
    found = originals(df, key, payload, least_bytes)
    rows = rows.join(found, ["sha", "length"], "left")
    # A payload whose keys are all null has no original to name: its rows are responses.
    rows = rows.select("key", "url", "__payload", "original", F.col("original").isNotNull().alias("repeated"))
    return cut_lineage(map_arrow(rows, work, ARCHIVES))


def read(archives: DataFrame, folder: str) -> DataFrame:
    """The records of the archives in the table, one row each; payload digests are verified."""

    def work(batches):
        store, base = _store(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{base}/{name}") as raw:
                    rows = []
                    for headers, block in read_archive(raw):
                        rows.append(_row(headers, block))
                        if len(rows) == 4096:
                            yield _columns(rows)
                            rows = []
                    yield _columns(rows)

    # An archive is one task's work, as its size is that of one task's rows.
    return map_arrow(_spread(archives), work, RECORDS)


def _spread(archives: DataFrame) -> DataFrame:
    many = max(1, archives.count())
    return archives.select("archive").repartitionByRange(min(many, 100_000), "archive")


def _row(headers: dict[str, str], block: bytes) -> tuple:
    told = headers["warc-payload-digest"].removeprefix("sha1:")
    http, _, payload = block.partition(b"\r\n\r\n")
    if headers["warc-type"] == "response":
        if digest(payload) != told:
            raise ValueError(f"the payload of {headers['warc-record-id']} does not match its digest")
        size = len(payload)
    else:
        size = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    page, other = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
    return (
        None if page is None else int(page), headers["warc-target-uri"], size, told, headers["warc-type"],
        None if other is None else int(other),
    )


def _columns(rows: list[tuple]) -> dict:
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:/", "file:///", 1))
