"""Archives: payloads stay where they are, records are valid, files are bounded."""

import gzip
import re

import pytest

from conftest import SF_TINY
from tallyline.llm import common, places, warc

SCHEMA = "page_id long, url string, html string, record_type string"


def read(spark, path):
    names = ["page_id", "record_type", "refers_to", "payload_bytes"]
    return sorted((tuple(r) for r in warc.read_archives(spark, path).select(*names).collect()), key=str)


def expected_of(rows):
    """By brute force over (page_id, html)."""
    out = []
    for page, html in rows:
        same = [p for p, h in rows if (h or "") == (html or "") and p is not None]
        other = max(same) if same and page != max(same) else None
        out.append((page, "revisit" if other is not None else "response", other, len((html or "").encode())))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [8, places.ROUND])
def test_rounds_of_references_give_the_same_records(spark, tmp_path, limit):
    rows = [(i if i % 11 else None, f"text {i % 7}" if i % 5 else None) for i in range(60)] + [(3, "text 3")] * 2
    pages = spark.createDataFrame([(p, "u", h, "x") for p, h in rows], SCHEMA).repartition(5)
    warc.write_archives(pages, str(tmp_path / "w"), limit=limit)
    assert read(spark, str(tmp_path / "w")) == expected_of(rows)


def test_payloads_are_not_shuffled(spark):
    placed = warc._placed(spark.read.parquet(f"{SF_TINY}/pages.parquet"), "run")
    heads = common.stored(warc.headers(placed), "headers")
    found = common.stored(warc.references(heads), "references")
    assert not {"html", "url"} & set(heads.columns + found.columns)
    plan = warc.archived(placed, found, "date")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and all("BroadcastExchange" in line for line in exchanges)


def test_records_have_dates_and_their_own_ids(spark, tmp_path):
    rows = [(1, "u", "same", "x"), (1, "u", "same", "x"), (None, "u", "same", "x"), (0, "u", "same", "x"), (None, None, None, "x")]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w"))
    found = [h for p in (tmp_path / "w").glob("part-*") for h, _ in warc.records(gzip.decompress(p.read_bytes()))]
    ids = [h["WARC-Record-ID"] for h in found]
    assert len(set(ids)) == len(rows)
    assert all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", i) for i in ids)
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["WARC-Date"]) for h in found)
    responses = {h["WARC-Record-ID"] for h in found if h["WARC-Type"] == "response"}
    refers = [h["WARC-Refers-To"] for h in found if h["WARC-Type"] == "revisit"]
    assert len(refers) == 2 and set(refers) <= responses


def test_files_are_bounded_by_bytes(spark, tmp_path):
    long, medium = "ö" * (3 << 20), "m" * (200 << 10)
    rows = [(i, "u", long + str(i), "x") for i in range(3)] + [(9, "u", long + "0", "x")]
    rows += [(100 + i, "u", medium + str(i), "x") for i in range(70)] + [(1000 + i, "u", f"s{i}", "x") for i in range(2100)]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "w"))
    assert read(spark, str(tmp_path / "w")) == expected_of([(p, h) for p, _, h, _ in rows])
    for part in (tmp_path / "w").glob("part-*"):
        found = list(warc.records(gzip.decompress(part.read_bytes())))
        sizes = [int(h["X-Payload-Length"]) for h, _ in found]
        assert len(sizes) == 1 or (max(sizes) < 1 << 20 and len(sizes) <= 64) or (max(sizes) < 32 << 10 and len(sizes) <= 2000)


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_small_payloads_are_not_revisited(spark, tmp_path):
    rows = [(1, "u", "abc", "x"), (2, "u", "abc", "x"), (3, "u", "abcdef", "x"), (4, "u", "abcdef", "x")]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w"), least=4)
    assert [r[:3] for r in read(spark, str(tmp_path / "w"))] == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]
