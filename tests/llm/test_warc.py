import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from duolith.llm.warc import parse_records, read_records, reconstruct, write_archive


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.fixture
def pages(spark):
    rng = random.Random(1)
    rows = [(i, f"http://a/{i}\r\nX-Page: 99", rng.choice(["<p>é</p>", "<b>🎉</b>\r\n\r\nWARC/1.1", f"own {i}", "", None])) for i in range(200)]
    rows += [(500, None, "z" * 400_000), (501, "u", "z" * 400_000), (7, "http://a/7", "seven"), (7, "http://a/7", "seven"), (None, "n", "nobody's"), (None, "n", "<p>é</p>")]
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, sha256 string").repartition(4)


def test_round_trip(spark, pages, tmp_path):
    write_archive(pages, str(tmp_path / "a"))
    rows = pages.collect()
    firsts = {}
    for r in rows:
        if r.page_id is not None or digest(r.html) not in firsts:
            old = firsts.get(digest(r.html))
            firsts[digest(r.html)] = r.page_id if old is None else min(old, r.page_id)
    got = read_records(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows)
    want = sorted((str(r.page_id), len((r.html or "").encode()), digest(r.html)) for r in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == want
    assert sum(r.record_type == "response" for r in got) == len(firsts)
    for r in got:
        if r.record_type == "response":
            assert r.page_id == firsts[r.payload_digest] and r.refers_to is None
        else:
            assert r.refers_to == firsts[r.payload_digest]
    payloads = spark.read.parquet(str(tmp_path / "a/payloads"))
    assert payloads.count() == payloads.select("sha256").distinct().count() == len(firsts)
    back = reconstruct(spark, str(tmp_path / "a")).collect()
    assert sorted((str(r.page_id), bytes(r.payload)) for r in back) == sorted((str(r.page_id), (r.html or "").encode()) for r in rows)
    for r in back:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest == (b"" if fields[b"WARC-Type"] == b"revisit" else bytes(r.payload)) + b"\r\n\r\n"
        assert int(fields[b"Content-Length"]) == len(rest) - 4


def test_small_payloads_are_all_responses(spark, pages, tmp_path):
    write_archive(pages, str(tmp_path / "a"), min_bytes=1 << 30)
    assert {r.record_type for r in read_records(spark, str(tmp_path / "a")).collect()} == {"response"}


def test_damage_is_found(spark, pages, tmp_path):
    write_archive(pages, str(tmp_path / "a"))
    spark.read.parquet(str(tmp_path / "a/payloads")).withColumn("payload", F.concat("payload", F.encode(F.lit("!"), "UTF-8"))).write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="damaged payload"):
        read_records(spark, str(tmp_path / "b")).collect()


def test_empty_table(spark, pages, tmp_path):
    write_archive(pages.limit(0), str(tmp_path / "a"))
    assert read_records(spark, str(tmp_path / "a")).count() == 0 and reconstruct(spark, str(tmp_path / "a")).count() == 0


def test_query_goes_through_whole_records(spark, tmp_path, monkeypatch):
    from duolith.llm import warc

    rows = [(1, "http://a/\r\n\r\nx", "é\r\n\r\nX-Page: 9\r\n"), (2, None, None), (3, "http://b/", "é\r\n\r\nX-Page: 9\r\n"), (4, "http://c/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    paths = []
    monkeypatch.setattr(warc, "reconstruct", lambda s, path: paths.append(path) or reconstruct(s, path))
    got = sorted(map(tuple, warc.query(spark, str(tmp_path)).collect()))
    assert len(paths) == 1 and got == sorted(map(tuple, read_records(spark, paths[0]).collect()))
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [(1, 17, "response", None), (2, 0, "response", None), (3, 17, "revisit", 1), (4, 0, "revisit", 2)]


def test_ids_that_headers_must_escape(spark, tmp_path):
    rows = [("a\r\nX-Page: b", "u", "one"), ("", "u", "one"), ("50%0A", "u\n\n", "two"), (None, "u", "two"), ("z", None, None)]
    write_archive(spark.createDataFrame(rows, "page_id string, url string, html string"), f"{tmp_path}/w")
    for got in (read_records(spark, f"{tmp_path}/w"), parse_records(reconstruct(spark, f"{tmp_path}/w"))):
        found = {r.page_id: (r.record_type, r.refers_to) for r in got.collect()}
        assert found == {"": ("response", None), "a\r\nX-Page: b": ("revisit", ""), "50%0A": ("response", None), None: ("revisit", "50%0A"), "z": ("response", None)}
