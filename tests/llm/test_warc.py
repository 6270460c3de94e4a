import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import warc
from lorekeep.llm.tables import new_dir

SCHEMA = "page_id bigint, url string, html string, payload string, date int"
BIG = "<html>" + "x" * 200


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 1) for i, u, h in rows], SCHEMA)


def by_page(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["row_id"], []).append((r["record_type"], r["refers_to_row"], r["payload_bytes"], r["payload_digest"]))
    return out


def test_revisits(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "é" * 80
    rows = [(5, "http://a/\r\nX: y", BIG), (3, None, BIG), (9, "u", BIG), (1, "u", "small"), (2, "u", "small"), (4, "u", None),
            (6, "u", ""), (7, "u", tricky), (8, "u", tricky), (10, "u", "é" * 50), (11, "u", "é" * 50), (12, "u", "y" * 99), (13, "u", "y" * 99)]
    found = by_page(warc.deduplicated_pages(pages(spark, rows).repartition(4)))
    assert {i: v[0][:2] for i, v in found.items()} == {
        3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), 1: ("response", None), 2: ("response", None),
        4: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("revisit", 7), 10: ("response", None),
        11: ("revisit", 10), 12: ("response", None), 13: ("response", None),
    }
    for i, _, html in rows:
        data = (html or "").encode()
        assert found[i][0][2:] == (len(data), hashlib.sha256(data).hexdigest())


def test_repeated_rows_null_ids_and_no_rows(spark):
    found = by_page(warc.deduplicated_pages(pages(spark, [(1, "u", BIG), (1, "u", BIG), (None, "u", BIG)])))
    assert sorted(x[0] for x in found[1]) == ["response", "revisit"] and found[None][0][:2] == ("revisit", 1)
    assert warc.deduplicated_pages(pages(spark, [])).count() == 0


def test_archives_read_back_and_resolve_again(spark):
    first, second, third = (new_dir(spark, "warc") for _ in range(3))
    rows = [(i, f"http://h/{i}", BIG if i % 3 else f"{i}" * 150) for i in range(40)]
    warc.write_archives(warc.page_records(pages(spark, rows), "page_id", "url", "html"), first, records_per_file=7)
    back = {r["row_id"]: r for r in warc.read_archives(spark, first).collect()}
    assert {i: bytes(r["payload"]).decode() for i, r in back.items()} == {i: h for i, _, h in rows}
    assert all(r["uri"] == f"http://h/{i}" for i, r in back.items())
    warc.resolve_revisits(spark, first, second)
    once = by_page(warc.read_archives(spark, second, payload=False))
    warc.resolve_revisits(spark, second, third)  # revisits in the source stay what they are
    assert by_page(warc.read_archives(spark, third, payload=False)) == once
    ids = {r["record_id"]: r for r in warc.read_archives(spark, third).collect()}
    revisits = [r for r in ids.values() if r["record_type"] == "revisit"]
    assert revisits and all(ids[r["refers_to_id"]]["row_id"] == r["refers_to_row"] and r["payload"] is None for r in revisits)


def test_every_file_is_a_gzip_of_whole_records(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    warc.write_archives(warc.page_records(pages(spark, [(1, "u", BIG), (2, "u", "b")]).coalesce(1), "page_id", "url", "html"), path)
    (file,) = (tmp_path / "out").glob("part-*")
    records = list(warc.parse_archive(gzip.decompress(file.read_bytes())))
    assert [h["x-row-id"] for h, _ in records] == ["1", "2"]
    assert records[0][1].endswith(BIG.encode())


def test_broken_archives_raise():
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse_archive(b"nothing\r\n\r\n"))
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse_archive(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_hot_payload(spark):
    rows = spark.range(600).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 1, BIG).otherwise(F.repeat(F.col("id").cast("string"), 60)).alias("html"))
    found = by_page(warc.deduplicated_pages(rows))
    assert sum(v[0][0] == "revisit" for v in found.values()) == 199
    assert all(v[0][1] == 1 for i, v in found.items() if i % 3 == 1 and i != 1)
