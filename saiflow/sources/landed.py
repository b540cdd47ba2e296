"""Landed responses as files (S9, S10): raw bytes to ``raw_pages`` rows.

A crawler leaves each response as it came, one file each, some of them
compressed. ``binaryFile`` lists and reads them, as a batch or a stream;
a UDF on Arrow batches undoes gzip and decodes the text by the
character set that the page declares. What cannot be read is not lost: it is a
row with a ``reason``.

Where code and page number stand is told by patterns on the path, each with
one group (a path that a pattern does not fit gives a null).
"""

from __future__ import annotations

import codecs
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
#: Chinese pages declare the older sets; the newest one reads all three.
CHARSETS = {"gb2312": "gb18030", "gbk": "gb18030"}
DECLARED = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]


def decode_response(raw: bytes | None, default: str = "utf-8", most: int = 64 << 20) -> tuple[str | None, str | None]:
    """(text, reason): the text of a response, or why it has none (empty, bad_gzip, too_long, bad_charset, bad_text).

    Gzip is known by its first two bytes. Of the character sets, a byte-order mark goes before what the page
    declares in its first 2048 bytes, and that before ``default``. A response that unpacks to more than ``most`` bytes is too long.
    """
    if not raw:
        return None, "empty"
    if raw[:2] == b"\x1f\x8b":
        out, rest = [], raw
        try:
            while rest:  # a file may hold several members
                unpack = zlib.decompressobj(31)
                out.append(unpack.decompress(rest, most + 1))
                if sum(map(len, out)) > most or unpack.unconsumed_tail:
                    return None, "too_long"
                if not unpack.eof:
                    return None, "bad_gzip"
                rest = unpack.unused_data.lstrip(b"\0")
        except zlib.error:
            return None, "bad_gzip"
        raw = b"".join(out)
    for mark, name in MARKS:
        if raw.startswith(mark):
            raw, charset = raw[len(mark):], name
            break
    else:
        said = DECLARED.search(raw[:2048])
        charset = said.group(1).decode().lower() if said else default
    try:
        return raw.decode(CHARSETS.get(charset, charset)), None
    except LookupError:
        return None, "bad_charset"
    except UnicodeDecodeError:
        return None, "bad_text"


def landed_responses(spark: SparkSession, folder: str, code_pattern: str = "", page_pattern: str = "", stream: bool = False,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """page_no, code, url, html, fetched_at, reason of every file in ``folder``; ``html`` is null where ``reason`` is not.

    The fetch time is the file's own. Spark's reader passes over files of no bytes.
    """
    reader = spark.readStream if stream else spark.read
    if stream and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = reader.format("binaryFile").schema(BINARY_FILE).load(folder)

    def part(pattern: str):
        return F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")) if pattern else F.lit(None).cast("string")

    @F.pandas_udf("struct<html:string,reason:string>")
    def decoded(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_response(c) for c in content], columns=["html", "reason"])

    d = F.col("_decoded")
    return files.withColumn("_decoded", decoded("content")).select(
        part(page_pattern).try_cast("int").alias("page_no"), part(code_pattern).alias("code"), F.col("path").alias("url"), d["html"].alias("html"),
        F.col("modificationTime").cast("timestamp_ntz").alias("fetched_at"), d["reason"].alias("reason"))


def split_rejects(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``raw_pages`` rows, rows that could not be read: url, fetched_at, reason)."""
    return responses.where("reason is null").drop("reason"), responses.where("reason is not null").select("url", "fetched_at", "reason")
