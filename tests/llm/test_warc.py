"""Archives: written by Spark, read back through split boundaries and payloads that look like records."""

import base64
import hashlib
import random

import pytest

from shopmetrics.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, size long, lead string, file string"
FAKE = (
    "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:fake>\r\nWARC-Page-ID: 999\r\n"
    "Content-Length: 7\r\n\r\nX\r\n\r\nab\r\n\r\n"
)


def rows_of(seed, long):
    rng = random.Random(seed)
    parts = ["WARC/1.1\r\n", "\r\n\r\n", FAKE, "é€😀", "text ", "WARC/1.1", "\r\n", "Content-Length: 9\r\n\r\n", "x" * 300]
    rows = []
    for k in range(200):
        html = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        rows.append((k, f"https://a.test/{k}", html))
    rows += [(500 + k, "u", rows[7][2]) for k in range(30)]
    rows += [(600, None, None), (601, "a\r\nWARC-Page-ID: 5\r\n", ""), (None, "v", "only here"), (None, "w", "only here"), (None, "v", None)]
    rows += [(700, "t", "again")] * 3 + [(701, "t", "again"), (800, "big", "long " * long), (801, "big", FAKE * (long // 60))]
    rows += [(900 + k, "x", "WARC/1.1") for k in range(3)]
    rng.shuffle(rows)
    return rows


def brute(rows, min_bytes):
    groups = {}
    for page, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((page, url))
    out = []
    for payload, pages in groups.items():
        pages.sort(key=lambda p: (p[0] is None, p[0] or 0, p[1] is None, p[1] or ""))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for k, (page, _) in enumerate(pages):
            revisit = k > 0 and len(payload) >= min_bytes
            out.append((page, len(payload), digest, "revisit" if revisit else "response", pages[0][0] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("split", "min_bytes", "long"), [("128m", 0, 200_000), ("700", 0, 600), ("30k", 200, 60_000)])
def test_round_trip(spark, tmp_path, split, min_bytes, long):
    rows = rows_of(len(split), long)
    pages = spark.createDataFrame([(*r, "d", 1, "l", "f") for r in rows], SCHEMA).repartition(3)
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, min_bytes)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = warc.read_records(spark, path)
        # Every record is where a plain reader finds it, and nothing else is.
        assert sorted((r.file.rsplit("/")[-1], r.start) for r in records.collect()) == plain_starts(tmp_path / "warc")
        found = warc.resolve(records).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=str) == brute(rows, min_bytes)
    assert all(r.digest_ok for r in found)


def plain_starts(folder):
    out = []
    for file in folder.glob("part-*"):
        data, at = file.read_bytes(), 0
        while at < len(data):
            assert data.startswith(b"WARC/1.1\r\n", at)
            end = data.index(b"\r\n\r\n", at) + 4
            length = next(int(x[15:]) for x in data[at:end].split(b"\r\n") if x.startswith(b"Content-Length:"))
            assert data[end + length : end + length + 4] == b"\r\n\r\n"
            out.append((file.name, at))
            at = end + length + 4
    return sorted(out)


def test_broken_files(spark, tmp_path):
    record = lambda n, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: {n}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    body = "HTTP/1.1 200 OK\r\n\r\npage"
    (tmp_path / "cut").write_bytes((record(1, body) + record(2, body) + record(3, body))[:-12].encode())
    (tmp_path / "gap").write_bytes((record(4, body) + "junk" + record(5, body)).encode())
    (tmp_path / "junk").write_bytes(("junk" + record(6, body)).encode())
    (tmp_path / "odd").write_bytes((record(7, body) + "WARC/1.1\r\nno header\r\n\r\n" + record(8, body)).encode())
    (tmp_path / "none").write_bytes(b"")
    for split in ("128m", "40"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            assert sorted(r.page_id for r in warc.read_records(spark, str(tmp_path)).collect()) == [1, 2, 4, 7]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert warc.resolve(warc.read_records(spark, str(tmp_path / "none"))).count() == 0


def test_base32(spark):
    df = spark.createDataFrame([(bytes([k, 255 - k]) * 3,) for k in range(50)], "b binary")
    for r in df.select("b", warc.base32_of_hex(warc.F.sha1("b")).alias("d")).collect():
        assert r.d == base64.b32encode(hashlib.sha1(bytes(r.b)).digest()).decode()
