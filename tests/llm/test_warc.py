"""WARC archives: exact round trips, records inside payloads, split and packed files, broken chains, revisits."""

import gzip
import hashlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamarack.llm import queries, warc


def record(payload: bytes, kind="resource", version="1.0", extra="") -> bytes:
    return f"WARC/{version}\r\nWARC-Type: {kind}\r\nwarc-page-id: {len(payload)}\r\n{extra}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


FAKE = "\r\n\r\n" + record(b"inner payload").decode() + record(b"x" * 40, version="1.1").decode()


def make_pages():
    html = ["plain", None, "", FAKE, "WARC/1.1\r\n", "\r\nWARC/1.0\r\n\r\n", "é" * 600, "\r\n\r\n\r\n", "\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabc", "x" * 999, "y" * 1000, FAKE * 30]
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(html)]
    rows += [(100 + i, "u", "y" * 1000) for i in range(40)] + [(200, None, "é" * 600), (201, "a\r\nWARC/1.1\r\nb", FAKE * 30)]
    return [*rows, (139, "u", "y" * 1000), (None, "u", "y" * 1000), (None, "u", None), (300, "u", "x" * 999)]


@pytest.mark.parametrize("split", ["128m", "4000"])
def test_round_trip(spark, tmp_path, split):
    pages = spark.createDataFrame([(*r, "extra", 1) for r in make_pages()], "page_id long, url string, html string, payload string, size int").repartition(3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for packed in ("none", "gzip"):
            path = f"{tmp_path}/{packed}"
            warc.write_warc(pages, path, compression=packed)
            got = warc.read_warc(spark, path).withColumn("payload", F.col("payload").cast("string")).collect()
            assert len(got) == len(make_pages())
            responses = sorted(((r["page_id"], r["payload"]) for r in got if r["record_type"] == "response"), key=str)
            revisits = sorted((r["page_id"] for r in got if r["record_type"] == "revisit"), key=str)
            again = {10, *range(100, 139), 6, 11, None}
            want = [(i, t or "") for i, _, t in make_pages() if (i not in again or (i is None and t is None))]
            assert responses == sorted(((str(i) if i is not None else None, t) for i, t in want), key=str)
            assert revisits == sorted((str(i) if i is not None else None for i in again), key=str)
            ids = {r["record_id"]: r["page_id"] for r in got if r["record_type"] == "response"}
            assert {ids[r["refers_to"]] for r in got if r["record_type"] == "revisit"} == {"139", "200", "201"}
            assert all(r["digest"] == "sha1:" + hashlib.sha1(r["payload"].encode()).hexdigest() for r in got if r["record_type"] == "response")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def chain(data: bytes) -> list[tuple[int, bytes]]:
    """Offsets and contents, one record after the other."""
    out, at = [], 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at) + 4
        length = int(data[at:head].split(b"Content-Length: ")[1].split(b"\r\n")[0])
        out.append((at, data[head : head + length]))
        at = head + length + 4
    return out


def test_foreign_archives(spark, tmp_path):
    payloads = [b"", b"\xff\x00\r\n", FAKE.encode(), (FAKE * 20).encode(), b"WARC/1.0\r\n\r\n", b"z" * 5000] * 5
    data = b"".join(record(p, version=["1.0", "1.1"][i % 2], extra="X-Note: WARC/1.0 here\r\n") for i, p in enumerate(payloads))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(data)
    (tmp_path / "in" / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(p)) for p in payloads))  # a member for each record
    for split in ("3000",):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = warc.read_warc(spark, f"{tmp_path}/in").select("path", "offset", "payload", "record_type").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        plain = sorted((r["offset"], bytes(r["payload"])) for r in got if r["path"].endswith("a.warc"))
        assert plain == chain(data)
        assert sorted(bytes(r["payload"]) for r in got if r["path"].endswith(".gz")) == sorted(payloads)
        assert {r["record_type"] for r in got} == {"resource"}


def test_broken_chains(spark, tmp_path):
    whole = record(b"one") + record(FAKE.encode()) + record(b"three")
    for name, data in {"cut": whole[:-30], "lead": b"\r\n" + whole, "length": whole.replace(b"Content-Length: 5", b"Content-Length: 6"), "none": b"no archive"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(data)
        with pytest.raises(ValueError, match="file's end"):
            warc.read_warc(spark, f"{tmp_path}/{name}")
    first = warc.read_warc(spark, f"{tmp_path}/cut", check=False).collect()
    assert sorted(bytes(r["payload"]) for r in first) == sorted([b"one", FAKE.encode()])
    assert warc.read_warc(spark, f"{tmp_path}/lead", check=False).count() == 0


def test_query(spark, tmp_path):
    rows = make_pages()
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    got = queries.QUERIES["op13_warc"](spark, str(tmp_path))
    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": pd.array([r[0] for r in rows], "Int64"), "html": pd.Series([r[2] for r in rows], dtype=object)}))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['op13_warc']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert queries.QUERIES["op13_warc"](spark, f"{tmp_path}/none").count() == 0
