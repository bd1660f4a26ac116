"""Rows dropped by their place, in one round and in several."""

import pytest

from tallyline.llm import common, places, simhash


@pytest.mark.parametrize("limit", [16, places.ROUND])
def test_rows_are_dropped_by_place(spark, limit):
    names = "id long, file string, row long, _metadata string"
    rows = [(i, f"f{i % 3}", i % 7, None) for i in range(90)]
    table = common.stored(spark.createDataFrame(rows, names).repartition(3), "table")
    file, row = places.place_of(table)
    found = table.where("id % 2 = 0").select(file.alias("file"), row.alias("row"))
    ranges = places.rounds(found, limit)
    assert (len(ranges) > 1) == (limit == 16)
    left = places.without(table, found, limit)
    assert left.columns == table.columns
    assert sorted(r.id for r in left.collect()) == list(range(1, 90, 2))


def test_texts_are_not_shuffled_to_drop_copies(spark):
    rows = [(i, f"text of number {i // 3} with some words", f"__fp {i}") for i in range(30)]
    docs = common.stored(spark.createDataFrame(rows, "doc_id long, text string, __fp string"), "docs")
    kept = simhash.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 30, 3))
    exchanges = [x for x in kept._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert exchanges and all("BroadcastExchange" in x for x in exchanges)
