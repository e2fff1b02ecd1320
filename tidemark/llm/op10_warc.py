"""WARC archives compressed with Zstandard and a dictionary.

Layout: a leading skippable frame (magic 0x184D2A5D) whose content is the dictionary, then one
frame for each record, compressed with that dictionary. An archive without a dictionary starts with
its first record. Archives are cut at a size, so that reader and writer hold one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shared import bounded_batches, shared_dir

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DATE = re.compile(r"\d{4}(-\d\d(-\d\d(T\d\d:\d\d(:\d\d(\.\d{1,9})?)?Z)?)?)?")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str) -> str:
    """A header value on one line, reversible: line ends and % are percent-encoded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def unclean(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, place: str = "") -> bytes:
    """A WARC/1.1 record. A revisit has the HTTP head of its payload and not the payload. place, which
    tells records apart that hold the same, makes the record's id."""
    digest = base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    named = uuid.uuid5(uuid.NAMESPACE_URL, f"{place} {page_id} {url}")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{named}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {clean(url)}"] if url is not None else []
    lines += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"] if revisit else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = head.decode().split("\r\n")
    found: dict[str, str] = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in found:
            raise ValueError(f"bad header line {line[:80]!r}")
        found[name.lower()] = value.strip()
    return first, found


#: Headers that the format asks of every record.
REQUIRED = ("warc-record-id", "warc-date", "warc-type", "content-length")


def parse_record(data: bytes) -> tuple | None:
    """A record's fields as in READ_SCHEMA; None for a sound record that is no response or revisit.
    Raises ValueError where headers are missing, or headers, lengths or digests do not agree."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, h = headers(head)
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    if missing := [x for x in REQUIRED if not h.get(x)]:
        raise ValueError(f"headers missing: {missing}")
    if not h["content-length"].isdecimal() or not DATE.fullmatch(h["warc-date"]):
        raise ValueError("bad Content-Length or WARC-Date")
    length = int(h["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise ValueError("Content-Length and the record's length differ")
    if h.get("warc-block-digest", "").startswith("sha1:") and h["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("the block's digest differs")
    if h["warc-type"] not in ("response", "revisit"):
        return None
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, hh = headers(http)
    revisit, digest = h["warc-type"] == "revisit", h.get("warc-payload-digest", "").removeprefix("sha1:")
    if not gap or not status.startswith("HTTP/1."):
        raise ValueError("bad HTTP head")
    size = int(hh["content-length"]) if hh.get("content-length", "").isdecimal() else None if revisit else len(payload)
    if revisit and (payload or not h.get("warc-profile") or size is None or not digest):
        raise ValueError("bad revisit")
    if not revisit and (len(payload) != size or base32_sha1(payload) != (digest or base32_sha1(payload))):
        raise ValueError("the payload's length or digest differs")
    page, refers, url = h.get("x-page-id"), h.get("x-refers-to-page-id"), h.get("warc-target-uri")
    return (
        None if page is None else int(page), None if url is None else unclean(url), h["warc-type"], size, digest or base32_sha1(payload),
        int(refers) if revisit and refers not in (None, "None") else None, None if revisit else payload,
    )


def archive_head(records: list[bytes], dictionary_bytes: int) -> tuple[bytes, object]:
    """The skippable frame and the dictionary in it, trained on these records; nothing where they are too few to train on."""
    import zstandard

    try:
        trained = zstandard.train_dictionary(dictionary_bytes, records)
    except zstandard.ZstdError:
        return b"", None
    raw = trained.as_bytes()
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw, trained


def read_archive(source: BinaryIO, piece: int = 1 << 18) -> Iterator[tuple]:
    """The responses and revisits of one archive: the dictionary from the leading skippable frame, then
    frame by frame, a record each. What is held is the dictionary, one record and a piece of input."""
    import zstandard

    held = source.read(piece)
    dictionary = None
    if held[:4] == struct.pack("<I", DICTIONARY_MAGIC):
        held += source.read(max(0, 8 - len(held)))
        size = struct.unpack_from("<I", held, 4)[0] if len(held) >= 8 else -1
        while -1 < len(held) - 8 < size and (more := source.read(piece)):
            held += more
        raw, held = held[8 : 8 + size], held[8 + size :]
        if size < 0 or len(raw) != size:
            raise ValueError("the dictionary frame is cut short")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary itself may be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while held or (held := source.read(piece)):
        while len(held) < 4 and (more := source.read(piece)):
            held += more
        if held[:4] != struct.pack("<I", FRAME_MAGIC):
            raise ValueError("no frame where one has to start")
        one, record = reader.decompressobj(), []
        while not one.eof:
            if not held and not (held := source.read(piece)):
                raise ValueError("the last frame is cut short")
            record.append(one.decompress(held))
            held = one.unused_data if one.eof else b""
        if (row := parse_record(b"".join(record))) is not None:
            yield row


def opened(path: str) -> tuple:
    """The store and the folder in it of a path or URI, by pyarrow.fs (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else f"file://{path}")


def write_archives(records: DataFrame, path: str, *, dictionary_bytes: int = 32_768, sample_records: int = 400, archive_bytes: int = 8_000_000) -> DataFrame:
    """Write (page_id, url, payload binary, refers_to, revisit) as archives under path; their list (name, records, bytes).

    Each archive has a dictionary trained on its first sample_records records. Names hold the task
    attempt, and the list, a Parquet table in path/list that Spark commits, has the archives of the
    attempts that succeeded: what a lost executor leaves behind is never read.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyspark import TaskContext

        where, folder = opened(path)
        task = TaskContext.get()
        waiting: list[bytes] = []
        files = held = 0
        own = uuid.uuid4().hex

        def flush() -> pd.DataFrame:
            head, dictionary = archive_head(waiting[:sample_records], dictionary_bytes)
            packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary) if dictionary else zstandard.ZstdCompressor(level=3)
            name, size = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{files:05d}.warc.zst", len(head)
            with where.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(head)
                for record in waiting:
                    size += out.write(packer.compress(record))
            return pd.DataFrame({"name": [name], "records": [len(waiting)], "bytes": [size]})

        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(batch[c] for c in ("page_id", "url", "payload", "refers_to", "revisit")), strict=True):
                waiting.append(record_bytes(None if page_id is None else int(page_id), url, bytes(payload), None if refers_to is None else int(refers_to), bool(revisit), f"{own} {files} {len(waiting)}"))
                held += len(waiting[-1])
                if held >= archive_bytes:
                    yield flush()
                    waiting, files, held = [], files + 1, 0
        if waiting:
            yield flush()

    where, folder = opened(path)
    where.create_dir(folder, recursive=True)
    narrow = records.select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"), "revisit")
    narrow.mapInPandas(write, "name string, records long, bytes long").write.parquet(f"{path}/list")
    return records.sparkSession.read.parquet(f"{path}/list")


def read_archives(names: DataFrame, path: str) -> DataFrame:
    """All records of the archives in path that names lists, as READ_SCHEMA says. An archive that does
    not hold what it says fails the read; sound records of other types (warcinfo, request, metadata and
    so on) are passed over. A task holds one record and a batch of rows at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, folder = opened(path)
        for batch in batches:
            for name in batch["name"]:
                with where.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    rows, held = [], 0
                    for row in read_archive(f):
                        rows.append(row)
                        held += len(row[-1] or b"")
                        if held > 4_000_000:
                            yield frame(rows)
                            rows, held = [], 0
                    if rows:
                        yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in READ_SCHEMA.split(", ")], dtype=object)
        return out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    many = names.count()
    return names.select("name").repartition(max(1, min(many, 20_000))).mapInPandas(read, READ_SCHEMA)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload: Column, least_bytes: int) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit). Of equal payloads of least_bytes or more, the row
    of the smallest page_id (then url; null last) is the response. Rows equal in all three are one
    capture and take the same part."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    mark = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("b"), F.col("url").isNull().alias("c"), F.col("url").alias("d"))
    firsts = rows.where(F.octet_length("payload") >= least_bytes).groupBy(F.col("digest").alias("of")).agg(F.min(mark).alias("first"), F.count("*").alias("many"))
    firsts = firsts.where("many > 1").drop("many")
    joined = rows.join(firsts, rows["digest"] == firsts["of"], "left")
    revisit = F.col("first").isNotNull() & ~mark.eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("first.b")).alias("refers_to"), revisit.alias("revisit"))


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, **how: int) -> DataFrame:
    """Write a record for every row of pages into archives in the shared folder and read them back.

    The result is read_archives(): one row for each row of pages. Null html is an empty payload, null
    ids and urls are left out of the record and come back null, texts may be of any length that fits a
    cell, an empty table makes no archive, and further columns are dropped. Ids are whole numbers. Rows of the same page_id,
    url and payload are the same capture; where it is the first of its payload all are responses.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    bounded_batches(spark)
    return read_archives(write_archives(with_revisits(pages, id_col, url_col, payload, least_bytes), path, **how), path)
