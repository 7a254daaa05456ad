import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from statloom.llm import warc
from statloom.llm.base import new_path


def table(spark):
    rows = [(5, "http://a\nb", "<p>é</p>", "x"), (2, None, "<p>é</p>", "x"), (9, "u", None, "x"), (7, "v", "", "x"), (1, "w", "one", "x"), (2, None, "<p>é</p>", "x"), (None, "n", "<p>é</p>", "x"), (11, "long", "y" * 300_000, "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string"), rows


def test_round_trip(spark):
    df, rows = table(spark)
    got = warc.archive_round_trip(df).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for p, _, h, _ in rows if p == r["page_id"])
        payload = (html or "").encode()
        same = min(p for p, _, h, _ in rows if p is not None and (h or "") == (html or ""))
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == same else ("revisit", same))
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_records_and_single_storage(spark, tmp_path):
    df, rows = table(spark)
    path = new_path(spark, "records")
    warc.write_archive(df, path)
    got = {(r["page_id"], bytes(r["record"]), bytes(r["payload"])) for r in warc.read_records(spark, path).collect()}
    payloads = {(p, (h or "").encode()) for p, _, h, _ in rows}
    assert {(p, x) for p, _, x in got} == payloads
    for p, record, payload in got:
        head, block = record.split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n")
        http, body = block[:-4].split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and b"Content-Length: %d" % len(payload) in http
        assert body == (b"" if b"WARC-Type: revisit" in head else payload)
        assert b"Content-Length: %d\r\n" % len(block[:-4]) in head + b"\r\n"
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    target = str(tmp_path / "files")
    warc.write_warc(warc.read_records(spark, path), target)
    read = []
    for file in Path(target).glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:  # as any reader of WARC files: header, length, block
            head, rest = data.split(b"\r\n\r\n", 1)
            n = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
            assert rest[n : n + 4] == b"\r\n\r\n"
            read.append(head + b"\r\n\r\n" + rest[: n + 4])
            data = rest[n + 4 :]
    assert sorted(read) == sorted(bytes(r["record"]) for r in warc.read_records(spark, path).collect())
    warc.delete_archive(spark, path)


def test_least_size_and_tampering(spark):
    df, _ = table(spark)
    path = new_path(spark, "least")
    warc.write_archive(df, path, least=1)
    index = {r["page_id"]: r["record_type"] for r in warc.read_index(spark, path).collect()}
    assert index[7] == index[9] == "response" and index[5] == "revisit"
    broken = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other"))
    broken.write.mode("overwrite").parquet(f"{path}2/payloads")
    spark.read.parquet(f"{path}/headers").write.mode("overwrite").parquet(f"{path}2/headers")
    with pytest.raises(SparkRuntimeException):
        warc.read_index(spark, f"{path}2").collect()
