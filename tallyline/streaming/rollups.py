"""Rollups that follow a stream.

Layout below one root per rollup::

    partials/batch_id=<n>/   sums of micro-batch n, replaced when n is replayed
    merged/upto=<n>/         sums of all batches up to n, written by compaction
    _until                   the time up to which an initial load holds all events
    _checkpoint/             the stream's own state

A reader takes the newest complete ``merged`` directory and the partials after it.  Checkpoint and
partials live and die together, because batch numbers start again with a new checkpoint.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyline.functions import calendar, money
from tallyline.functions.ratios import is_type
from tallyline.operators import ingest
from tallyline.operators.rollup import ROLLUPS, Rollup, finish, merge, partials
from tallyline.schemas import SALE
from tallyline.sources import storage
from tallyline.streaming.sinks import trigger


def store_partials(events: DataFrame, batch_id: int, rollup: Rollup, root: str) -> None:
    path = f"{root}/{rollup.name}/partials/batch_id={batch_id}"
    partials(events, rollup).write.mode("overwrite").parquet(path)


def start_rollups(
    messages: DataFrame, root: str, rollups: Sequence[Rollup] = ROLLUPS, live: bool = False
) -> StreamingQuery:
    """Keep the rollups up to date; rows of any age count, whenever they arrive."""

    def store(batch: DataFrame, batch_id: int) -> None:
        events = ingest.parse_events(batch, lenient=True).drop("value")
        if len(rollups) > 1:
            events.persist()
        try:
            for rollup in rollups:
                store_partials(events, batch_id, rollup, root)
        finally:
            if len(rollups) > 1:
                events.unpersist()

    return (
        messages.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(**trigger(live))
        .start()
    )


def _complete(spark: SparkSession, path: str, label: str) -> list[int]:
    """Numbers of the committed ``label=<n>`` directories below ``path``."""
    found = storage.matching(spark, path, f"{label}=*/_SUCCESS")
    return sorted(int(name.split("/")[0].removeprefix(f"{label}=")) for name in found)


def _current_paths(
    spark: SparkSession, root: str, rollup: Rollup, upto: int | None = None
) -> tuple[list[str], int]:
    """The directories that hold all batches (``upto`` one), and the last batch number."""
    base = f"{root}/{rollup.name}"
    generations = [
        n for n in _complete(spark, f"{base}/merged", "upto") if upto is None or n <= upto
    ]
    start = generations[-1] if generations else -1
    batches = [
        n
        for n in _complete(spark, f"{base}/partials", "batch_id")
        if n > start and (upto is None or n <= upto)
    ]
    paths = [f"{base}/partials/batch_id={n}" for n in batches]
    if generations:
        paths.append(f"{base}/merged/upto={start}")
    if not paths:
        raise ValueError(f"no complete batch of rollup {rollup.name} below {root}")
    return paths, max([start, *batches])


def _merged_rows(
    spark: SparkSession, root: str, rollup: Rollup, upto: int | None = None
) -> tuple[DataFrame, int]:
    """One partial row per key over all batches (``upto`` one), and the last batch number."""
    paths, last = _current_paths(spark, root, rollup, upto)
    return merge(spark.read.parquet(*paths), rollup), last


def read_rollup(spark: SparkSession, root: str, rollup: Rollup) -> DataFrame:
    rows, _ = _merged_rows(spark, root, rollup)
    return finish(rows, rollup)


def load_rollup(
    events: DataFrame, root: str, rollup: Rollup, until: dt.datetime | None = None
) -> None:
    """Initial load: sums of the events stored before the stream's first batch, as ``upto=-1``.

    With ``until`` only events before it are taken, all of which ``events`` must hold; it is recorded,
    so that reports can add the events from then on (:mod:`tallyline.plans.rolled`).
    """
    base, spark = f"{root}/{rollup.name}", events.sparkSession
    storage.remove(spark, f"{base}/_until")
    rows = events if until is None else calendar.before(events, until)
    partials(rows, rollup).write.mode("overwrite").parquet(f"{base}/merged/upto=-1")
    if until is not None:
        storage.create_text(spark, f"{base}/_until", until.isoformat())


def loaded_until(spark: SparkSession, root: str, rollup: Rollup) -> dt.datetime | None:
    """The time up to which the rollup holds all events, if its load recorded one."""
    path = f"{root}/{rollup.name}/_until"
    return dt.datetime.fromisoformat(storage.read_text(spark, path)) if storage.exists(spark, path) else None


def stored_partials(spark: SparkSession, root: str, rollup: Rollup) -> DataFrame:
    """The partial rows of the newest generation and the batches after it, not yet added up."""
    return spark.read.parquet(*_current_paths(spark, root, rollup)[0])


def compact_rollup(spark: SparkSession, root: str, rollup: Rollup) -> int | None:
    """Merge all batches but the last, which may still be replayed; returns the number reached.

    The result counts once it is complete, so a compaction that dies half-way changes nothing.
    """
    base = f"{root}/{rollup.name}"
    batches = _complete(spark, f"{base}/partials", "batch_id")
    done = _complete(spark, f"{base}/merged", "upto")
    if len(batches) < 2 or (done and batches[-2] <= done[-1]):
        return None
    rows, upto = _merged_rows(spark, root, rollup, upto=batches[-2])
    rows.write.mode("overwrite").parquet(f"{base}/merged/upto={upto}")
    return upto


def vacuum_rollup(spark: SparkSession, root: str, rollup: Rollup) -> int:
    """Remove directories that the newest complete generation has replaced."""
    base = f"{root}/{rollup.name}"
    done = _complete(spark, f"{base}/merged", "upto")
    if not done:
        return 0
    stale = [f"{base}/merged/upto={n}" for n in done[:-1]]
    stale += [
        f"{base}/partials/batch_id={n}"
        for n in _complete(spark, f"{base}/partials", "batch_id")
        if n <= done[-1]
    ]
    for path in stale:
        storage.remove(spark, path)
    return len(stale)


def windowed_hourly(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The hourly rollup as a watermarked stream: rows later than ``delay`` are dropped.

    In append mode an hour is emitted once it can no longer change.
    """
    events = ingest.parse_events(messages, lenient=True).where(is_type(SALE))
    return (
        events.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 hour"), "store_id", "category")
        .agg(
            F.count("*").alias("transaction_count"),
            F.sum("quantity").alias("total_quantity"),
            money.money_sum("unit_price", "quantity").alias("total_revenue"),
        )
        .select(
            calendar.hour_bucket(F.col("window.start")).alias("hour"),
            "store_id",
            "category",
            "transaction_count",
            "total_quantity",
            "total_revenue",
        )
    )
