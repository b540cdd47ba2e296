"""WARC archives as Zstandard files, one frame per record, with a dictionary in front.

Layout of an archive: a skippable frame (magic 0x184D2A5D) that holds the
compression dictionary, then one Zstandard frame per WARC/1.1 record. An
archive whose records are too few to train a dictionary has no leading frame.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with
the smallest id is written as a response; the others become revisit records
that name it and hold only their HTTP header. Copies are found by SHA-256 with
an aggregate (combined before the shuffle), so a payload that a third of all
pages share costs one row per task.

Each writing task writes files of its own name into ``folder`` and returns
their names through Spark's result, so files of failed or repeated attempts
are never read. Readers decode frame by frame and check each record.

Defined results: a null payload is the empty payload; a null id is kept as
null and never chosen as the response of others unless all are null; repeated
rows of the smallest id are all responses; an empty table writes no archive
and reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, stage

SKIPPABLE = 0x184D2A5D
DICT_MAGIC = b"\x37\xa4\x30\xec"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URI = "urn:saiflow:page:"
RECORD_COLUMNS = ("page_id string, url string, record_type string, refers_to string, payload_bytes long, "
                  "payload_digest string, payload binary, archive string, frame long, error string")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# records ---------------------------------------------------------------
def build_record(page_id, url, payload: bytes, refers_to, is_revisit: bool, date: str) -> bytes:
    """One WARC record, as bytes. The HTTP header carries the full payload's length."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if is_revisit else http + payload
    target = re.sub(r"[\x00-\x20]", "", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}",
            f"WARC-Record-ID: <{RECORD_URI}{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"WARC-Block-Digest: sha1:{payload_digest(block)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if target:
        head.append(f"WARC-Target-URI: {target}")
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_URI}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = head.decode("utf-8").split("\r\n")
    fields = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"header line without a name: {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    return first, fields


def _page(uri: str) -> str | None:
    if not (uri.startswith(f"<{RECORD_URI}") and uri.endswith(">")):
        raise ValueError(f"record id {uri[:60]!r}")
    return uri[len(RECORD_URI) + 1:-1] or None


def parse_record(raw: bytes) -> dict:
    """Check one record's headers, lengths and digests; returns its fields. Raises ValueError."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("record header does not end")
    version, f = _fields(head)
    if version != "WARC/1.1":
        raise ValueError(f"version {version[:20]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in f:
            raise ValueError(f"no {name}")
    if not f["content-length"].isdigit():
        raise ValueError("Content-Length is not a number")
    n = int(f["content-length"])
    block, end = rest[:n], rest[n:]
    if len(block) != n or end != b"\r\n\r\n":
        raise ValueError(f"Content-Length {n}, but the record goes on for {len(rest) - 4} bytes")
    if f.get("warc-block-digest") != f"sha1:{payload_digest(block)}":
        raise ValueError("block digest")
    http, blank, payload = block.partition(b"\r\n\r\n")
    status, h = _fields(http)
    if not blank or not status.startswith("HTTP/") or not h.get("content-length", "").isdigit():
        raise ValueError("HTTP header")
    size, digest, kind = int(h["content-length"]), f.get("warc-payload-digest", ""), f["warc-type"]
    if kind == "response":
        if len(payload) != size or digest != f"sha1:{payload_digest(payload)}":
            raise ValueError("payload length or digest")
        refers = None
    elif kind == "revisit":
        if payload or f.get("warc-profile") != REVISIT_PROFILE or "warc-refers-to" not in f:
            raise ValueError("revisit record")
        payload, refers = None, _page(f["warc-refers-to"])
    else:
        raise ValueError(f"type {kind[:20]!r}")
    return {"page_id": _page(f["warc-record-id"]), "url": f.get("warc-target-uri"), "record_type": kind, "refers_to": refers,
            "payload_bytes": size, "payload_digest": digest.removeprefix("sha1:"), "payload": payload}


# frames ----------------------------------------------------------------
def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A Zstandard dictionary for ``samples``, or b"" where they are too few or too small."""
    import zstandard

    if len(samples) < 16 or sum(map(len, samples)) < 16 * size // 4:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return SKIPPABLE.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary


def read_frames(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The records of an archive, one per frame. ``stream`` has read(n). Raises ValueError on a damaged file."""
    import zstandard

    have = stream.read(8)
    dictionary = None
    if len(have) == 8 and int.from_bytes(have[:4], "little") == SKIPPABLE:
        n = int.from_bytes(have[4:], "little")
        body = stream.read(n)
        if len(body) != n:
            raise ValueError("the dictionary frame is cut off")
        if body[:4] != DICT_MAGIC:
            body = zstandard.ZstdDecompressor().decompress(body)
        dictionary, have = zstandard.ZstdCompressionDict(body), b""
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        have = have or stream.read(chunk)
        if not have:
            return
        frame, parts = reader.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(have))
            except zstandard.ZstdError as e:
                raise ValueError(f"damaged frame: {e}") from None
            if frame.eof:
                have = frame.unused_data
                break
            have = stream.read(chunk)
            if not have:
                raise ValueError("the last frame is cut off")
        yield b"".join(parts)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


# tables ----------------------------------------------------------------
def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None, min_bytes: int) -> DataFrame:
    """page_id, url, payload, refers_to, is_revisit of each row."""
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("_sha", F.unhex(F.sha2("payload", 256)))
    copies = (rows.filter(F.octet_length("payload") >= min_bytes).groupBy("_sha")
              .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return (rows.join(copies, "_sha", "left").withColumn("is_revisit", again)
            .select("page_id", "url", "payload", F.when(again, F.col("_first")).alias("refers_to"), "is_revisit"))


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html",
                   url_col: str | None = "url", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
                   archive_bytes: int = 32 << 20, dictionary_bytes: int = 32 << 10, level: int = 3) -> DataFrame:
    """Write ``pages`` as archives into ``folder`` (shared, made if missing); returns path, records, bytes of each."""
    marked = mark_revisits(pages, id_col, payload_col, url_col, min_bytes)
    marked = marked.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        done, waiting, size = [], [], 0

        def flush() -> None:
            samples, room = [], 100 * dictionary_bytes  # the trainer's advice: a hundred times the dictionary
            for r in waiting:
                if room <= 0:
                    break
                samples.append(r[:room])
                room -= len(r)
            dictionary = train_dictionary(samples, dictionary_bytes)
            args = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
            packer = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True, **args)
            path, total = f"{base}/{uuid.uuid4().hex}.warc.zst", 0
            with system.open_output_stream(path, compression=None) as out:
                if dictionary:
                    total += out.write(dictionary_frame(dictionary)) or 0
                for r in waiting:
                    out.write(packer.compress(r))
            done.append((f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}", len(waiting), system.get_file_info(path).size))

        for b in batches:
            for page, url, payload, refers, again in zip(b.page_id, b.url, b.payload, b.refers_to, b.is_revisit):
                record = build_record(page, url, bytes(payload), refers, again, date)
                waiting.append(record)
                size += len(record)
                if size >= archive_bytes:
                    flush()
                    waiting, size = [], 0
        if waiting:
            flush()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return stage(spark, marked.mapInPandas(write, "path string, records long, bytes long"), "warc-manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, payload: bool = True, on_error: str = "raise") -> DataFrame:
    """The records of the archives that ``manifest`` (column path) lists, one row each.

    ``on_error="report"`` gives a damaged record as a row with its ``error``
    (and ends that archive if its frames cannot be followed); "raise" fails.
    """
    if on_error not in ("raise", "report"):
        raise ValueError(on_error)
    names = [c.split()[0] for c in RECORD_COLUMNS.split(", ")]

    def rows(path: str) -> Iterator[dict]:
        system, at = _filesystem(path)
        nth = 0
        with system.open_input_stream(at, compression=None) as stream:
            try:
                for raw in read_frames(stream):
                    try:
                        row = parse_record(raw)
                    except (ValueError, UnicodeDecodeError) as e:
                        if on_error == "raise":
                            raise ValueError(f"{path}, record {nth}: {e}") from e
                        row = {"error": str(e)}
                    if not payload:
                        row["payload"] = None
                    yield row | {"archive": path, "frame": nth}
                    nth += 1
            except ValueError as e:
                if on_error == "raise":
                    raise
                yield {"error": str(e), "archive": path, "frame": nth}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                waiting, size = [], 0
                for r in rows(path):
                    waiting.append([r.get(c) for c in names])
                    size += len(r.get("payload") or b"") + 500
                    if size > 8 << 20:
                        yield pd.DataFrame(waiting, columns=names, dtype=object)
                        waiting, size = [], 0
                if waiting:
                    yield pd.DataFrame(waiting, columns=names, dtype=object)

    # each archive is a unit of work: spread the few manifest rows over all tasks
    return manifest.select("path").repartition(spread(spark), "path").mapInPandas(read, RECORD_COLUMNS)
