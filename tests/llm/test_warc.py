"""Archives: round trips, pushdown, foreign files, the query against its SQL."""

import gzip

import duckdb
import pytest

from maskwright.llm import warc


@pytest.fixture(scope="module")
def known(spark):
    warc.register(spark)
    return spark


ROWS = [
    ("urn:a:1", "response", "http://x.org/1 2", None, None, warc.digest_of(b"one"), 3, b"one"),
    ("urn:a:2", "response", None, "2020-02-02T00:00:00Z", None, warc.digest_of(b""), 0, b""),
    ("urn:a:3", "revisit", "http://x.org/3", None, "urn:a:1", warc.digest_of(b"one"), 3, None),
    ("urn:a:4", "response", "http://y.org/\r\né", None, None, warc.digest_of(b"WARC/1.1\r\n\r\n" * 9000), 108_000, b"WARC/1.1\r\n\r\n" * 9000),
]


def write(spark, path, rows=ROWS, **options):
    frame = spark.createDataFrame(rows, warc.SCHEMA).repartition(2)
    frame.write.format("warc").options(**options).mode("overwrite").save(path)


def test_round_trip(known, tmp_path):
    write(known, str(tmp_path / "w"), file_bytes=50)
    got = {r.record_id: r for r in known.read.format("warc").option("partition_bytes", 10).load(str(tmp_path / "w")).collect()}
    assert len(got) == 4 and len(list((tmp_path / "w").glob("*.warc.gz"))) == 4
    for row in ROWS:
        r = got[row[0]]
        assert (r.record_type, r.refers_to, r.payload_digest, r.payload_length) == (row[1], *row[4:7])
        assert r.payload == (None if row[1] == "revisit" else row[7])
    assert got["urn:a:1"].target_uri == "http://x.org/1%202" and got["urn:a:2"].target_uri is None and got["urn:a:2"].date.startswith("2020")
    # each record is a gzip member that other readers understand
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("*.warc.gz"))
    assert whole.count(b"WARC-Type: ") == 4


def test_predicates_are_pushed_down(known, tmp_path, monkeypatch):
    write(known, str(tmp_path / "w"))
    frame = known.read.format("warc").load(str(tmp_path / "w"))
    ids = lambda f: {r.record_id[-1] for r in f.select("record_id").collect()}
    cases = {
        "record_type = 'revisit'": "3", "target_uri like 'http://x.org%'": "13", "target_uri is null": "2", "record_id in ('urn:a:1', 'urn:a:9')": "1",
        "not target_uri like '%3'": "14", "refers_to = 'urn:a:1' and payload_length = 3": "3", "target_uri != 'http://x.org/3'": "14", "record_id like '%:4'": "4",
    }
    for condition, want in cases.items():
        assert ids(frame.filter(condition)) == set(want), condition
    reader = warc.WarcReader(str(tmp_path / "w"), {}, known.createDataFrame([], warc.SCHEMA).schema)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_length",), 3)]))
    assert [f.attribute for f in left] == [("payload_length",)]
    # only as much is inflated as the header needs
    inflated = []
    real = warc.Inflated.more
    monkeypatch.setattr(warc.Inflated, "more", lambda self: inflated.append(self.start) or real(self))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["record_id"] for r in rows] == ["urn:a:3"] and len(inflated) == 4


def test_without_payload(known, tmp_path):
    write(known, str(tmp_path / "w"))
    got = {r.record_id[-1]: r for r in known.read.format("warc").option("payload", "false").load(str(tmp_path / "w")).collect()}
    assert {k: r.payload_length for k, r in got.items()} == {"1": 3, "2": 0, "3": 3, "4": 108_000} and not any(r.payload for r in got.values())


def test_foreign_archives(known, tmp_path):
    names = warc.SCHEMA.replace(" string", "").replace(" long", "").replace(" binary", "").split(", ")
    rows = [dict(zip(names, r)) for r in ROWS]
    (tmp_path / "plain.warc").write_bytes(b"".join(map(warc.encode_record, rows)))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "z.warc.gz").write_bytes(b"".join(gzip.compress(warc.encode_record(r)) for r in rows))
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Type: application/warc-fields\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "info.warc").write_bytes(info)
    frame = known.read.format("warc").load(str(tmp_path))
    assert frame.count() == 9
    assert frame.filter("record_type = 'warcinfo'").first().payload == b"hello"
    assert {bytes(r.payload) for r in frame.filter("record_type = 'response'").collect()} == {r[7] for r in ROWS if r[7] is not None}


def test_files_of_lost_tasks_are_not_read(known, tmp_path):
    write(known, str(tmp_path / "w"))
    first = next((tmp_path / "w").glob("*.warc.gz"))
    (tmp_path / "w" / "lost.warc.gz").write_bytes(first.read_bytes())
    assert known.read.format("warc").load(str(tmp_path / "w")).count() == 4
    write(known, str(tmp_path / "w"), ROWS[:1])
    assert known.read.format("warc").load(str(tmp_path / "w")).count() == 1
    assert not first.exists()


def test_query_equals_its_sql(known, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    cursor = con.execute(warc.OP5_SQL)
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall(), key=str)
    got = sorted((tuple(r) for r in warc.op5_warc(known, sf).select(*names).collect()), key=str)
    assert got == want and len(got) == known.read.parquet(f"{sf}/pages.parquet").count()


def test_defined_cases(known, tmp_path):
    rows = [(1, "u", "same", 0), (2, None, "same", 0), (2, "v", "same", 0), (None, "w", "same", 0), (3, "u", None, 0), (4, "u", "", 0), (None, "q", "alone", 0), (None, "q", "alone", 0), (9, "u", "x" * 300_000, 0)]
    pages = known.createDataFrame(rows, "page_id long, url string, html string, record_type int")
    got = sorted((str(r.record_id[9:]), r.record_type, r.refers_to, r.payload_length) for r in warc.archive_rows(pages).collect())
    assert got == sorted([("1", "revisit", "urn:page:2", 4), ("2", "response", None, 4), ("2", "response", None, 4), ("", "revisit", "urn:page:2", 4), ("3", "revisit", "urn:page:4", 0),
                          ("4", "response", None, 0), ("", "response", None, 5), ("", "response", None, 5), ("9", "response", None, 300_000)])
    small = {r.record_id: r.record_type for r in warc.archive_rows(pages, 4).collect()}
    assert small["urn:page:3"] == "response" and small["urn:page:1"] == "revisit"
    warc.archive_rows(pages.limit(0)).write.format("warc").mode("overwrite").save(str(tmp_path / "e"))
    assert known.read.format("warc").load(str(tmp_path / "e")).count() == 0
