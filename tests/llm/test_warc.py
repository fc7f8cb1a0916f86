"""Archives against a plain reading of the same records."""

import base64
import hashlib

import pytest

from tidewise.llm import warc


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and (b not in first or i < first[b]):
            first[b] = i
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ref = first.get(b)
        again = ref is not None and ref != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", ref if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


INNER = "WARC/1.0\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = (
    [(i, f"http://a.org/{i}", f"<p>{'x' * (i * 37 % 900)} {i // 3}</p>") for i in range(200)]
    + [(1000 + i, "u\r\nContent-Length: 3", f"WARC/1.0\r\n{INNER * (i % 4)}WARC/1.0\r\nno header {i}\r\n\r\n") for i in range(40)]
    + [(2000, None, None), (2001, "", ""), (None, "n", "lonely"), (None, "n", "<p></p>"), (2002, "é", "é\n\r\n\r\nü"), (2003, "d", "same"), (2003, "d", "same"), (2004, "d", "same"), (2005, "l", "WARC/1.0\r\n" + "y" * 300_000)]
)


@pytest.mark.parametrize("split", ["128m", "2k"])
def test_round_trip(spark, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("value", warc.F.lit(1)).repartition(3)
        assert rows_of(warc.round_trip(df)) == expected(ROWS)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty(spark):
    assert rows_of(warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"))) == []


def test_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write(df, path)
    known = warc.chain(spark, path)
    got = warc.contents(spark, path, known.where("owner IS NOT NULL"))
    want = {(h or "").encode() for _, _, h in ROWS}
    assert {bytes(r.payload) for r in got.collect()} == want | {b""}


def test_threshold(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    kinds = warc.plan_records(df, "page_id", "url", "html", 3).selectExpr("value LIKE '%WARC-Type: revisit%' AS r").collect()
    assert sum(r.r for r in kinds) == 1
