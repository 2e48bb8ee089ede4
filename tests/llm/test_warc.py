import gzip
import glob
import hashlib

from loreweave.llm import warc
from loreweave.llm.common import shared_path

FALSE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:66>\r\nContent-Length: {}\r\n\r\n"


def case():
    long = "<p>" + "ö" * 200 + "</p>"
    rows = [(i, f"http://x/{i}", f"<html>{i % 7} " + "y" * 120) for i in range(60)]
    rows += [(100, "u", None), (101, None, ""), (102, "a b\r\nX: y", "short"), (103, "u", "short"), (104, "u", long * 5000)]
    # Payloads that hold the magic line, whole false records and false lengths.
    rows += [(200, "u", "a\r\n\r\n" + FALSE.format(3) + "abc\r\n\r\n" + "t" * 100), (201, "u", FALSE.format(10**7)), (202, "u", "WARC/1.0\r\n" * 40)]
    rows += [(203, "u", "\r\n\r\nWARC/1.0\r\n\r\n"), (204, "u", "WARWARC/1.0\r\nWARC/1.0\r"), (205, "u", FALSE.format("x")), (206, "u", FALSE.format(0) + "\r\n\r\n")]
    return rows + [(None, "u", rows[0][2]), (3, "other", rows[3][2]), (None, "u", "z" * 150)]


def brute(rows):
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        low = first.get(h)
        again = low is not None and low != i
        out.append(str((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", low if again else None)))
    return sorted(out)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "PER_FILE", 10)
    rows = case()
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, size int, digest string").repartition(3)
    got = warc.round_trip(pages).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == brute(rows)
    assert all(r.digest_ok for r in got)


def test_archive_format_and_damage(spark):
    pages = spark.createDataFrame([(i, "u", f"{i} " + "b" * 200) for i in range(5)], "page_id bigint, url string, html string").coalesce(1)
    path = shared_path(spark, "warc-test")
    warc.write(pages, path)
    (file,) = [f for f in glob.glob(path.removeprefix("file:") + "/part-*")]
    data = gzip.open(file).read()
    assert data.startswith(b"WARC/1.0\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n") and data.count(b"WARC-Record-ID: <urn:page:") == 5
    # A length that points past the next record ends the chain there.
    third = [m for m in range(len(data)) if data.startswith(b"WARC/1.0", m)][2]
    broken = data[:third] + data[third:].replace(b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: 9", 1)
    folder = shared_path(spark, "warc-broken").removeprefix("file:")
    import os

    os.makedirs(folder)
    with gzip.open(f"{folder}/part-0.txt.gz", "wb") as f:
        f.write(broken)
    got = warc.read(spark, folder).collect()
    assert len(got) == 3 and sum(bool(r.digest_ok) for r in got) == 2


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(pages).count() == 0


def test_urls_that_end_in_the_magic(spark, monkeypatch):
    monkeypatch.setattr(warc, "PER_FILE", 10)
    urls = ["https://host/spec/WARC/1.0", "WARC/1.0", "WARC/1.0\r\nWARC/1.0", "WARC-Target-URI: WARC/1.0", "WARC/1.0\r\n", "http://x/"]
    rows = [(i, urls[i % 6], f"{i % 9} " + "WARC/1.0\r\nWARC-Target-URI: " * (i % 4) + "WARC/1.0\r\n" * (i % 3) + "y" * 120) for i in range(60)]
    pages = spark.createDataFrame([*rows, (70, urls[0], None), (71, urls[0], "s")], "page_id bigint, url string, html string").coalesce(1)
    got = warc.round_trip(pages).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == brute([*rows, (70, urls[0], None), (71, urls[0], "s")])
    assert all(r.digest_ok for r in got)
