import gzip
import hashlib

import duckdb
from pyspark.sql import functions as F

from planloom.llm import common
from planloom.llm import warc as A

BIG, OTHER = "<p>" + "x" * 200 + "</p>", "<p>\r\n\r\nWARC/1.1 é\n" + "y" * 100
PAGES = [
    (1, "http://a.com/x?y#z", BIG),
    (2, "http://b.com", BIG),
    (3, None, "short"),
    (4, "http://c.com/ \r\nEvil: 1", "short"),
    (5, "x", None),
    (6, "http://d.com/", OTHER),
    (8, "http://d.com/", OTHER),
    (7, "http://d.com/", OTHER),
    (9, "http://e.com/", "z" * 300_000),
]


def table(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip_matches_sql(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = A.query(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(A.SQL).fetchall())
    by_id = {r["page_id"]: r for r in got.collect()}
    assert (by_id[2]["record_type"], by_id[2]["refers_to"]) == ("revisit", 1)
    assert (by_id[8]["refers_to"], by_id[7]["refers_to"], by_id[6]["refers_to"]) == (6, 6, None)
    assert by_id[4]["record_type"] == "response" and by_id[5]["payload_bytes"] == 0


def test_captures(spark):
    path = common.scratch(spark)
    A.write_archives(table(spark), path, records_per_file=5)
    assert len(spark.read.format("binaryFile").load(path).collect()) > 3
    records = A.read_archives(spark, path)
    assert records.count() == 3 * len(PAGES)
    captures = {r["metadata"][0]["fields"]["page-id"]: r for r in A.assemble(records).collect()}
    html = dict((i, h or "") for i, _, h in PAGES)
    for i, c in captures.items():
        assert len(c["requests"]) == len(c["metadata"]) == 1
        assert c["response"]["declared_digest"] == "sha256:" + hashlib.sha256(html[int(i)].encode()).hexdigest()
        if c["response"]["type"] == "response":
            assert bytes(c["response"]["payload"]).decode() == html[int(i)]
    assert captures["2"]["response"]["refers_to"] == captures["1"]["record_id"]
    assert captures["4"]["response"]["target_uri"] == "http://c.com/%20%20%20Evil:%201"
    assert captures["3"]["response"]["target_uri"] is None


def test_standard_form(spark):
    """What is written is a plain sequence of records, each ended by two line ends."""
    path = common.scratch(spark)
    A.write_archives(table(spark, PAGES[:2]), path)
    for f in spark.read.format("binaryFile").load(path).collect():
        data = gzip.decompress(bytes(f["content"]))
        at = 0
        while at < len(data):
            assert data.startswith(b"WARC/1.1\r\nWARC-Type: ", at)
            end = data.index(b"\r\n\r\n", at) + 4
            size = int(data[at:end].split(b"Content-Length: ")[1].split(b"\r\n")[0])
            assert data[end + size : end + size + 4] == b"\r\n\r\n"
            at = end + size + 4


def test_parse_foreign_archives():
    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [b for _, b in A.parse(one + one)] == [b"hello"] * 2
    assert [b for _, b in A.parse(gzip.compress(one) + gzip.compress(one))] == [b"hello"] * 2
    assert list(A.parse(b"")) == []


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "u", BIG), (1, "u", BIG), (1, "v", OTHER), (None, "u", BIG), (None, "u", "s"), (2, "w", OTHER)]
    table(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    got = A.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r["n_requests"] == 1 for r in got)
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got) == [
        (0, "response", 0),
        (0, "response", 0),
        (1, "response", 0),
        (1, "response", 0),
        (1, "revisit", 1),
        (2, "revisit", 1),
    ]


def test_empty(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "pages.parquet"))
    assert A.query(spark, str(tmp_path)).collect() == []


def test_missing_partners(spark):
    path = common.scratch(spark)
    A.write_archives(table(spark, PAGES[:3]), path)
    records = A.read_archives(spark, path, payloads=False).where("type != 'request'")
    assert A.assemble(records.where("type != 'metadata'")).where(F.size("metadata") + F.size("requests") == 0).count() == 3
    assert A.assemble(records.where("type = 'metadata'")).collect() == []


def test_large_pages(spark, tmp_path):
    """Pages of megabytes stand in archives of their own, and come back whole."""
    import hashlib

    big = ["<p>" + chr(97 + i % 26) * (3 << 20) + str(i) for i in range(12)]
    rows = [(i, f"http://e.org/{i}", h) for i, h in enumerate([*big, "small", big[0]])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    A.write_archives(df, f"file://{tmp_path}/w")
    assert len(list((tmp_path / "w").glob("*.gz"))) >= 14
    got = A.assemble(A.read_archives(spark, f"file://{tmp_path}/w", payloads=False)).collect()
    digests = {r["response"]["target_uri"]: r["response"]["payload_digest"] for r in got if r["response"]["type"] == "response"}
    assert digests == {u: hashlib.sha256(h.encode()).hexdigest() for i, u, h in rows if i != 13} and len(got) == 14


def test_many_pages_without_an_id(spark, tmp_path):
    """They are told apart by url and payload and never meet, also where ids repeat."""
    rows = [(None, f"http://e.org/{i}", f"page {i}") for i in range(40)] + [(1, "http://e.org/x", "a"), (1, "http://e.org/y", "b"), (None, None, None), (None, None, None)]
    A.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = A.assemble(A.read_archives(spark, f"file://{tmp_path}/w")).collect()
    assert len(got) == 44 and len({r["record_id"] for r in got}) == 44
    assert all(len(r["requests"]) == len(r["metadata"]) == 1 for r in got)


def test_one_pass_over_the_archives(spark, tmp_path):
    A.write_archives(spark.createDataFrame([(1, "http://e.org/x", "a")], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    plan = A.assemble(A.read_archives(spark, f"file://{tmp_path}/w"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("binaryFile") == 1


def test_records_across_parts(monkeypatch):
    """Wherever the unzipped parts end, in headers, blocks or between members, the records are the same."""
    record = lambda i, n: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n" % (i, n) + bytes([65 + i % 26]) * n + b"\r\n\r\n"
    sizes = [0, 1, 7, 300, 5000, 3]
    one = b"".join(record(i, n) for i, n in enumerate(sizes))
    members = b"".join(gzip.compress(record(i, n)) for i, n in enumerate(sizes))
    for data in (one, gzip.compress(one), members):
        for part in (1, 5, 64, 1 << 20):
            monkeypatch.setattr(A, "PART_BYTES", part)
            got = list(A.parse(data))
            assert [(h["warc-record-id"], b) for h, b in got] == [(f"<{i}>", bytes([65 + i % 26]) * n) for i, n in enumerate(sizes)]
    assert list(A.parse(b"")) == []
