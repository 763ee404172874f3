"""Archives: round trips, and refusal of what does not follow the formats."""

from __future__ import annotations

import base64
import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from barloom.llm import warc as W
from barloom.session import kept, shared_dir

PAGES = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same"), (2, "http://a/b c\n", "<p>ünï</p>"), (4, "u", None), (6, "u", ""), (None, "u", "same"), (None, "u", "alone"), (7, "x", "y" * 300_000), (8, "t", "twice"), (8, "t", "twice")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id bigint, url string, html string, payload string, size int")


def through_archives(spark, rows, **options):
    folder = shared_dir(spark, "warc")
    files = kept(W.write_archives(W.page_records(pages(spark, rows), **options), folder, W.train_dictionary(pages(spark, rows)), archive_bytes=2000)).collect()
    return files, W.read_archives(spark, folder)


def test_round_trip(spark):
    files, read = through_archives(spark, PAGES)
    rows = read.select(W.page_number("record_id").alias("id"), "record_type", W.page_number("refers_to").alias("to"), "payload_bytes", "payload_digest", "payload", "target_uri").collect()
    assert sum(f.n_records for f in files) == len(rows) == len(PAGES)
    full = {(i, (h or "").encode()) for i, _, h in PAGES}
    size = {base64.b32encode(hashlib.sha1(p).digest()).decode(): len(p) for _, p in full}
    assert all(size[r.payload_digest] == r.payload_bytes for r in rows)
    assert {(r.id, bytes(r.payload)) for r in rows if r.record_type == "response"} == {(5, b"same"), (2, "<p>ünï</p>".encode()), (6, b""), (None, b"alone"), (7, b"y" * 300_000), (8, b"twice")}
    assert sorted((str(r.id), r.to) for r in rows if r.record_type == "revisit") == [("1", 5), ("3", 5), ("4", 6), ("None", 5)]
    assert {r.target_uri for r in rows if r.id in (2, 3)} == {"http://a/b%20c%0A", None}


def test_small_payloads_can_all_respond(spark):
    _, read = through_archives(spark, PAGES, min_bytes=5)
    assert read.filter("record_type = 'revisit'").count() == 0


def test_dictionary_is_used_and_found_again(spark):
    rows = [(i, "u", "<html><body>" + " ".join(f"shared words {i * j % 97}" for j in range(60))) for i in range(200)]
    dictionary = W.train_dictionary(pages(spark, rows))
    assert dictionary
    folder = shared_dir(spark, "warc")
    kept(W.write_archives(W.page_records(pages(spark, rows)), folder, dictionary))
    data = [bytes(r.content) for r in spark.read.format("binaryFile").load(f"{folder}/*{W.SUFFIX}").select("content").collect()]
    assert all(struct.unpack("<I", d[:4])[0] == W.DICTIONARY_MAGIC for d in data)
    assert W.read_archives(spark, folder).agg(F.count("*")).first()[0] == 200


@pytest.mark.parametrize("html", [[], [None, ""], ["x"], ["ab" * 90_000], ["x"] * 300, [f"<p>{i}</p>" for i in range(7)], ["é" * 40_000 + "end"] * 3])
def test_every_archive_has_a_dictionary(spark, html):
    rows = [(i, "u", h) for i, h in enumerate(html)]
    dictionary = W.train_dictionary(pages(spark, rows))
    assert dictionary
    folder = shared_dir(spark, "warc")
    kept(W.write_archives(W.page_records(pages(spark, rows)), folder, dictionary))
    found = [bytes(r.content) for r in spark.read.format("binaryFile").load(f"{folder}*/*").select("content").collect()] if rows else []
    assert all(struct.unpack("<I", d[:4])[0] == W.DICTIONARY_MAGIC for d in found) and bool(found) == bool(rows)
    if rows:
        read = W.read_archives(spark, folder).filter("record_type = 'response'").collect()
        assert {bytes(r.payload) for r in read} == {(h or "").encode() for h in html}


def test_empty_table(spark):
    files, read = through_archives(spark, [(1, "u", "x")])
    folder = shared_dir(spark, "warc")
    assert kept(W.write_archives(W.page_records(pages(spark, [])), folder)).filter("archive IS NOT NULL").collect() == []


def frame(raw):
    return zstandard.ZstdCompressor(write_checksum=True).compress(raw)


GOOD = W.record_bytes("urn:page:1", "u", b"payload", W.sha1_base32(b"payload"), None)


@pytest.mark.parametrize(
    "raw",
    [
        GOOD[:-1], GOOD + b"x", b"WARC/9" + GOOD[8:], GOOD.replace(b"WARC-Date", b"WARC-Dote"), GOOD.replace(b"payload", b"paYload"), GOOD.replace(b"Content-Length: 7", b"Content-Length: 8"),
        GOOD.replace(b"WARC-Type: ", b"WARC-Type "), b"", b"WARC/1.1\r\n\r\n",
    ],
)
def test_refuses_broken_records(raw):
    with pytest.raises(W.ArchiveError):
        W.parse_record(raw)


def test_refuses_broken_archives():
    good = frame(GOOD) + frame(GOOD)
    assert len(list(W.records_of(good))) == 2
    plain = W.dictionary_frame(b"d" * 100)
    for bad in (good[:-3], good + b"junk", good[:20] + b"\xff" + good[21:], b"\x00" + good, plain[:9]):
        with pytest.raises(W.ArchiveError):
            [W.parse_record(r) for r in W.records_of(bad)]
