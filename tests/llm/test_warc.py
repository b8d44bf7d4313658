import zstandard
from pyspark.sql import functions as F

from gleanwork.llm import warc


def archive(path, frames, trained=b""):
    path.write_bytes(warc.archive_head(trained) + b"".join(frames))
    return str(path)


def frame(raw, trained=b"", **options):
    return zstandard.ZstdCompressor(write_checksum=True, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, **options).compress(raw)


def test_round_trip_of_odd_pages(spark):
    rows = [(1, "http://a/x", "<p>é</p>" * 50_000, "q"), (2, None, None, "q"), (3, "", "", "q"), (None, "u\r\nWARC-Type: fake", "line\r\n\r\nline", "q"), (4, "http://b", "same", "q"), (4, "http://b", "same", "q")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, path string")
    got = warc.round_trip(df)
    want = sorted((i if i is not None else -1, (u or "").replace("\r", "%0D").replace("\n", "%0A"), h or "", len((h or "").encode()), None) for i, u, h, _ in rows)
    assert sorted((r[0] if r[0] is not None else -1, *tuple(r)[1:]) for r in got.collect()) == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_every_split_gives_each_record_once(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").alias("body"))
    files = warc.write(pages, str(tmp_path / "a"), archive_bytes=20_000)
    assert files.agg(F.sum("n_records")).first()[0] == pages.count() and files.count() > 1
    for split in (1 << 30, 7_001, 997):
        got = warc.read(spark, str(tmp_path / "a"), split_bytes=split)
        assert got.filter("error is not null").count() == 0
        assert got.select("record_id").distinct().count() == got.count() == pages.count()


def test_dictionary_in_the_leading_frame(tmp_path):
    samples = [f"<html><body>page {i} of a set of pages that are alike {i * 7}</body></html>".encode() * 4 for i in range(300)]
    trained = warc.dictionary(samples)
    assert trained[:4] == warc._DICT
    records = [warc.record(f"<urn:record:{i}>", "http://x", "2024-01-01T00:00:00Z", s) for i, s in enumerate(samples)]
    packed = archive(tmp_path / "d.warc.zst", [frame(r, trained) for r in records], trained)
    assert [r["error"] for r in warc.read_range(packed, 0, 1 << 40)] == [None] * 300
    # a dictionary that isn't compressed is read too
    raw = warc._SKIPPABLE + len(trained).to_bytes(4, "little") + trained + b"".join(frame(r, trained) for r in records)
    (tmp_path / "r.warc.zst").write_bytes(raw)
    assert len([r for r in warc.read_range(str(tmp_path / "r.warc.zst"), 0, 1 << 40) if not r["error"]]) == 300
    (tmp_path / "n.warc.zst").write_bytes(b"".join(frame(r) for r in records))
    assert len(list(warc.read_range(str(tmp_path / "n.warc.zst"), 0, 1 << 40))) == 300
    (tmp_path / "bad.warc.zst").write_bytes(warc._SKIPPABLE + (4).to_bytes(4, "little") + b"none")
    assert "dictionary" in next(warc.read_range(str(tmp_path / "bad.warc.zst"), 0, 1 << 40))["error"]


def test_errors_are_reported_and_reading_goes_on(tmp_path):
    good = warc.record("<urn:record:1>", "http://x", "2024-01-01T00:00:00Z", b"body")
    broken = {
        "no WARC version line": b"HELLO\r\n\r\n", "headers don't end": b"WARC/1.1\r\nA: b", "missing header": good.replace(b"WARC-Date", b"X-Date"), "no number": good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: x", 1),
        "shorter than": good[:-20], "two line ends": good[:-4] + b"....", "bytes behind": good + b"more", "digest": good.replace(b"body", b"bodx"), "malformed header": good.replace(b"WARC-Type", b"no colon here\r\nWARC-Type"), "repeated header": good.replace(b"WARC-Type", b"WARC-Date: 1\r\nWARC-Type"),
    }
    frames = [f for raw in broken.values() for f in (frame(raw), frame(good))]
    corrupt = bytearray(frame(good))
    corrupt[-1] ^= 1
    path = archive(tmp_path / "e.warc.zst", [*frames, bytes(corrupt), frame(good), frame(good)[:-9]])
    got = list(warc.read_range(path, 0, 1 << 40))
    for k, what in enumerate(broken):
        assert what in got[2 * k]["error"] and got[2 * k + 1]["error"] is None
    assert got[20]["error"].startswith("frame") and got[21]["error"] is None and "cut off" in got[22]["error"]
    assert "longer than" in list(warc.read_range(archive(tmp_path / "l.warc.zst", [frame(good)]), 0, 1 << 40, max_record=10))[0]["error"]
    (tmp_path / "empty.warc.zst").write_bytes(b"")
    assert list(warc.read_range(str(tmp_path / "empty.warc.zst"), 0, 0)) == []


def test_columns_that_clash_and_bodies_in_many_rows(spark):
    """Columns named like those inside; one page in most rows, which the dictionary's sample takes once."""
    rows = [(k, f"http://h/{k}", f"<p>page {k} of the site</p>" * 20, "x", b"y", "z", 1) for k in range(60)] + [(7, "http://h/7", "<p>page 7 of the site</p>" * 20, "x", b"y", "z", 1)] * 200
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, uri string, body binary, error string, id int")
    got = warc.round_trip(pages).collect()
    assert len(got) == 260 and all(r["error"] is None and r["html"] == f"<p>page {r['page_id']} of the site</p>" * 20 for r in got)
    named = pages.selectExpr("page_id AS id", "url AS uri", "html AS body")
    assert len(warc.samples(named)) == 60 and all(len(x) == 30 for x in warc.samples(named, 5, 30)) and len(warc.samples(named, 5, 30)) == 5


def test_a_range_begins_in_the_middle_of_large_records(spark, tmp_path):
    """Records of more than a buffer, cut into ranges far smaller than one."""
    rows = spark.createDataFrame([(k, f"u{k}", "".join(chr(97 + (k * 7 + j * j) % 26) for j in range(300_000))) for k in range(12)], "id bigint, uri string, body string")
    warc.write(rows.coalesce(1), f"file://{tmp_path}/a", level=1).count()
    got = warc.read(spark, f"file://{tmp_path}/a", split_bytes=20_000).collect()
    assert sorted(r["target_uri"] for r in got) == sorted(f"u{k}" for k in range(12)) and all(r["error"] is None for r in got)
