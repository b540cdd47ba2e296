import base64
import hashlib
import io

import pytest
import zstandard
from saiflow.llm import archive


def test_round_trip_with_revisits(spark, tmp_path):
    page = "<html>" + "abc " * 300
    rows = [(3, "http://x/3", page, 1), (1, "http://x/1 a", page, 2), (2, None, None, 3), (7, "u", "", 4), (5, "u", "solo é\r\n\r\nx", 5),
            (9, "u", page, 6), (5, "u", "solo é\r\n\r\nx", 5)]
    rows += [(100 + k, f"http://x/{k}", f"<p>{k}</p>" + "lorem ipsum dolor " * (k % 40), k) for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path long").repartition(3)
    manifest = archive.write_archives(spark, df, str(tmp_path / "w"), archive_bytes=60_000, dictionary_bytes=2048)
    assert manifest.count() > 3
    got = archive.read_archives(spark, manifest).collect()
    first = {}
    for i, _, h, _ in sorted(rows):
        first.setdefault(h or "", i)
    want = sorted((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                   "response" if first[h or ""] == i else "revisit", "" if first[h or ""] == i else str(first[h or ""])) for i, _, h, _ in rows)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or "") for r in got) == want
    assert all(bytes(r.payload).decode() == {str(i): h or "" for i, _, h, _ in rows}[r.page_id] for r in got if r.record_type == "response")
    leading = [open(r.path, "rb").read(4) for r in manifest.collect()]
    assert archive.SKIPPABLE.to_bytes(4, "little") in leading


def test_small_payloads_can_stay_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = archive.read_archives(spark, archive.write_archives(spark, df, str(tmp_path), min_bytes=3))
    assert sorted((r.page_id, r.record_type) for r in got.collect()) == [("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive.read_archives(spark, archive.write_archives(spark, df, str(tmp_path))).count() == 0


def test_damage_is_found(spark, tmp_path):
    good = archive.build_record(1, "u", b"payload", None, False, "2024-01-01T00:00:00Z")
    assert archive.parse_record(good)["payload"] == b"payload"
    for bad in (good.replace(b"payload", b"pay1oad"), good[:-2], good + b"x", good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"X-Date"), b"junk"):
        with pytest.raises(ValueError):
            archive.parse_record(bad)
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(good)
    assert list(archive.read_frames(io.BytesIO(frame * 3), chunk=7)) == [good] * 3
    with pytest.raises(ValueError):
        list(archive.read_frames(io.BytesIO(frame + frame[:-3])))
    path = tmp_path / "a.warc.zst"
    path.write_bytes(frame + zstandard.ZstdCompressor().compress(good[:-1]) + frame)
    manifest = spark.createDataFrame([(str(path),)], "path string")
    rows = archive.read_archives(spark, manifest, on_error="report").collect()
    assert [r.error is None for r in sorted(rows, key=lambda r: r.frame)] == [True, False, True]
