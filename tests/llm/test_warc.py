import collections
import glob
import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from pageloom.llm import warc
from pageloom.session import run_dir

BODY = "<p>é</p>" * 40
ROWS = [(5, "http://a/?q=1", BODY), (3, "http://b/\r\nX: y", BODY), (9, None, BODY), (None, "http://c/", BODY), (1, "http://d/", "small"), (2, "http://e/", "small"),
        (4, "http://f/", None), (6, "http://g/%41", "\r\n\r\nWARC/1.1\r\n"), (7, "http://h/é", "x" * 400_000), (8, "http://i/", "y" * 100), (8, "http://i/", "y" * 100)]


def records(spark, rows):
    frame = spark.createDataFrame(rows, "id long, uri string, html string")
    frame = frame.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    frame = frame.withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return warc.with_revisits(frame).select(name("id").alias("record_id"), "uri", "record_type", "digest", "payload", "payload_bytes", name("refers_to").alias("refers_to"))


@pytest.fixture(params=[1 << 18, 1000])
def written(spark, monkeypatch, request):
    monkeypatch.setattr(warc, "FRAME_BYTES", request.param)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", request.param // 4)
    path = run_dir(spark, "warc-test")
    warc.write_bundles(records(spark, ROWS).coalesce(1), path)
    return path


def test_round_trip(spark, written):
    found = warc.read_records(spark, written).collect()
    assert sorted(r["record_id"] for r in found) == sorted(str(i) if i is not None else "null" for i, _, _ in ROWS)
    by_id = {r["record_id"]: r for r in found}
    for i, uri, html in ROWS:
        data, r = (html or "").encode(), by_id["null" if i is None else str(i)]
        assert (r["uri"], r["payload_bytes"], r["digest"]) == (uri, len(data), hashlib.sha256(data).hexdigest())
        again = html == BODY and i != 3
        assert (r["record_type"], r["refers_to"]) == (("revisit", "3") if again else ("response", None))
        assert r["payload"] == (None if again else data)


def test_single_records(spark, written):
    index = warc.read_index(spark, written)
    assert index.count() == len(ROWS)
    wanted = spark.createDataFrame([("7",), ("1",), ("9",), ("unknown",)], "record_id string")
    found = {r["record_id"]: r for r in warc.fetch(spark, written, wanted).collect()}
    assert set(found) == {"7", "1", "9"} and found["7"]["payload"] == b"x" * 400_000 and found["9"]["refers_to"] == "3"


def test_any_zstd_reader_can_read(spark, written):
    files = glob.glob(written.removeprefix("file:") + "/part-*")
    plain = collections.Counter()
    for name in files:
        with open(name, "rb") as file:
            data = file.read()
        reader = warc.Reader(data)
        text = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert text == b"".join(reader.frame(i) for i in range(len(reader.starts) - 1))
        plain.update({"records": text.count(b"WARC-Type:")})
        for record_id, frame, offset, length in reader.index():
            assert warc.parse_record(reader.frame(frame)[offset : offset + length])[0]["record_id"] == record_id
    assert plain["records"] == len(ROWS)


def test_damage_is_seen():
    record = warc.record_bytes("1", None, "response", hashlib.sha256(b"abc").hexdigest(), b"abd", 3, None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(record)


def test_no_pages(spark):
    path = run_dir(spark, "warc-test")
    warc.write_bundles(records(spark, []), path)
    assert warc.read_records(spark, path).collect() == [] and warc.read_index(spark, path).collect() == []


def test_nulls_and_clashing_names(spark):
    rows = [(None, None, None, None, None, None, None), ("a b", "u", "response", None, b"x" * 200, None, None), ("%", "", "response", None, None, None, None),
            (None, "u2", "revisit", "d", None, 5, None)]
    path = run_dir(spark, "warc-test")
    warc.write_bundles(spark.createDataFrame(rows, warc.RECORD), path)
    found = collections.Counter((r["record_id"], r["uri"], r["record_type"], r["payload"], r["payload_bytes"], r["refers_to"]) for r in warc.read_records(spark, path).collect())
    assert found == collections.Counter([
        (None, None, "response", b"", 0, None), ("a b", "u", "response", b"x" * 200, 200, None), ("%", "", "response", b"", 0, None), (None, "u2", "revisit", None, 5, None)])
    assert sorted(str(r["record_id"]) for r in warc.read_index(spark, path).collect()) == ["%", "None", "None", "a b"]
    wanted = spark.createDataFrame([("%",), (None,)], "record_id string")
    assert [r["record_id"] for r in warc.fetch(spark, path, wanted).collect()] == ["%"]
    clash = spark.createDataFrame([(1, "d", 200, "f", 7, "s"), (2, "d", 200, "f", 7, "s"), (3, None, None, "f", 7, "s"), (None, "d", 200, "f", 7, "s")],
                                  "id long, digest string, payload_bytes long, first string, _salt int, same string")
    found = {r["id"]: r for r in warc.with_revisits(clash).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in found.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), None: ("revisit", 1)}
    assert {(r["first"], r["_salt"], r["same"]) for r in found.values()} == {("f", 7, "s")}


def test_every_byte_survives(spark):
    data = bytes(range(256)) * 3000 + bytes(reversed(range(256)))
    path = run_dir(spark, "warc-test")
    warc.write_bundles(spark.createDataFrame([("1", None, "response", None, data, None, None)], warc.RECORD), path, level=-50)
    assert warc.read_records(spark, path).collect()[0]["payload"] == data
