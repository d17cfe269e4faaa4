import gzip
from collections import defaultdict

from oddsmill.llm import warc as W

SCHEMA = "page_id long, url string, html string, payload string"
ODD = [
    (1, "http://a/1", "<p>x</p>", "clash"),
    (2, "http://a/2", "<p>x</p>", "clash"),
    (3, None, None, "clash"),
    (4, "http://a/4\r\nEvil: yes", "", "clash"),
    (5, "http://ä/5", "a\r\n\r\nb\r\n\r\nWARC/1.1\r\n\r\n", "clash"),
    (None, "http://a/n", "lonely", "clash"),
    (None, "http://a/n", "<p>x</p>", "clash"),
    (7, "http://a/7", "é" * 300000, "clash"),
    (8, "http://a/8", "same", "clash"),
    (8, "http://a/8", "same", "clash"),
]


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2] or ""].append((r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[0]))
    out = []
    for r in rows:
        own, top = (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[0]), max(groups[r[2] or ""], key=lambda x: x[:4])
        data = (r[2] or "").encode()
        response = own == top
        out.append((r[0], len(data), W.base32_sha1(data), "response" if response else "revisit", None if response else top[4]))
    return sorted(out, key=str)


def through(spark, df, path):
    W.write_archives(df, path)
    out = W.resolved(W.assemble(W.read_archives(spark, path)))
    return sorted([tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=str)


def test_odd_pages(spark, tmp_path):
    assert through(spark, spark.createDataFrame(ODD, SCHEMA), str(tmp_path / "w")) == brute(ODD)
    assert through(spark, spark.createDataFrame([], SCHEMA), str(tmp_path / "e")) == []


def test_pages(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert through(spark, df, str(tmp_path / "w")) == brute([(r.page_id, r.url, r.html) for r in df.collect()])


def test_payloads_and_nested_rows(spark, tmp_path):
    df = spark.createDataFrame(ODD[:1] + ODD[4:5], SCHEMA)
    W.write_archives(df, str(tmp_path / "w"))
    rows = W.assemble(W.read_archives(spark, str(tmp_path / "w"))).collect()
    assert sorted(bytes(r.capture.payload).decode() for r in rows) == sorted(r[2] for r in ODD[:1] + ODD[4:5])
    assert all(r.n_requests == 1 and r.n_metadata == 1 and r.metadata.fields["page-id"] in ("1", "5") and r.request.target_uri == r.capture.target_uri for r in rows)


def test_small_payloads_are_not_shared(spark, tmp_path):
    W.write_archives(spark.createDataFrame(ODD, SCHEMA), str(tmp_path / "w"), least_bytes=5)
    types = {(r.page_id, r.record_type) for r in W.resolved(W.assemble(W.read_archives(spark, str(tmp_path / "w")))).collect()}
    assert (3, "response") in types and (4, "response") in types and (1, "revisit") in types


def test_concurrent_records_are_counted_not_multiplied(spark):
    rec = lambda i, kind, to=None: (i, kind, to, None, "u", "d", None, {}, None, None)
    df = spark.createDataFrame([rec("c", "response"), rec("r2", "request", "c"), rec("r1", "request", "c"), rec("m", "metadata", "x")], W._RECORD)
    row, = W.assemble(df).collect()
    assert row.n_requests == 2 and row.request.record_id == "r1" and row.metadata is None and row.n_metadata == 0


def test_archives_of_many_members_and_plain_ones():
    records = [r + b"\r\n\r\n" for i in range(50) for r in W.capture_records(i, f"http://h/{i}", "text " * i, None)]
    plain = list(W.parse_archive(b"".join(records), step=100))
    assert len(plain) == 150 and plain == list(W.parse_archive(b"".join(map(gzip.compress, records)), step=77))
