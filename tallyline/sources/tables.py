"""The stored event tables: the date-partitioned lake and the recent realtime table.

Both are laid out as ``<date parts>/load=<name>``.  Every write stands in a folder of its own until it
is done and is then renamed into place, so writers never share temporary files and readers never meet
half a directory.  Closed dates are merged, expired rows removed and named loads replaced by publishing
a new state (:mod:`tallyline.sources.published`): readers see the old directories or the new ones.
"""

from __future__ import annotations

import datetime as dt
import re
import time
import uuid
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.calendar import instant
from tallyline.schemas import LAKE, LAKE_PARTITIONS, REALTIME
from tallyline.sources import storage
from tallyline.sources.published import (
    DEFAULT_PARTITION, Range, State, forget_states, merged_ranges, publish, read_state, visible,
)

SORT_KEY = ("event_time", "store_id", "product_id")
#: Order of merged dates that lookups by product read: its rows are neighbours, so row groups and pages are skipped.
PRODUCT_KEY = ("product_id", "store_id", "event_time")
#: Products a file is expected to hold, for the Bloom filters of merged dates.
FILE_PRODUCTS = 200_000
RETENTION_DAYS = 90
#: Hours after which the directory of a change that was never published is taken for abandoned.
ABANDONED_HOURS = 24

_NAME = re.compile(r"[A-Za-z0-9_.+-]+")
_BATCH = re.compile(r"(.+)-(\d+)")


@dataclass(frozen=True)
class Table:
    """How a stored table is laid out."""

    schema: T.StructType
    partitions: tuple[str, ...]

    @property
    def loads(self) -> str:
        return "*/" * len(self.partitions) + "load=*"

    def date_of(self, place: str) -> dt.date | None:
        """The date of a directory; none for rows without one."""
        values = [part.split("=", 1)[1] for part in place.split("/")[: len(self.partitions)]]
        if DEFAULT_PARTITION in values:
            return None
        return dt.date.fromisoformat(values[0]) if len(values) == 1 else dt.date(*map(int, values))


LAKE_TABLE = Table(LAKE, tuple(LAKE_PARTITIONS))
REALTIME_TABLE = Table(REALTIME, ("event_date",))


# Writing


def _clustered(rows: DataFrame, path: str, table: Table, layout: dict[str, str]) -> tuple[str, list[str]]:
    """As :func:`_staged`, each date cut into ranges of :data:`PRODUCT_KEY`, which ends in the time, so that a
    product with a third of all rows is spread over files too."""
    folder = f"{path}/_staged/{uuid.uuid4().hex}"
    order = [*table.partitions, *PRODUCT_KEY]
    bloom = {
        "parquet.bloom.filter.enabled#product_id": "true",
        "parquet.bloom.filter.expected.ndv#product_id": str(FILE_PRODUCTS),
    }
    writer = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(*table.partitions)
    writer.options(**{**bloom, **layout}).parquet(folder)
    dates = "/".join("*=*" for _ in table.partitions)
    return folder, sorted(storage.matching(rows.sparkSession, folder, dates))


def _staged(rows: DataFrame, path: str, table: Table) -> tuple[str, list[str]]:
    """The rows written in a folder that readers do not list, and its date directories.

    The rebalance hint brings the rows of a date together but lets AQE cut a heavy one into several
    tasks, so neither many small files nor one huge writer results.  Sorting inside each file keeps
    its min/max statistics narrow.
    """
    folder = f"{path}/_staged/{uuid.uuid4().hex}"
    (
        rows.hint("rebalance", *table.partitions)
        .sortWithinPartitions(*table.partitions, *SORT_KEY)
        .write.partitionBy(*table.partitions)
        .parquet(folder)
    )
    dates = "/".join("*=*" for _ in table.partitions)
    return folder, sorted(storage.matching(rows.sparkSession, folder, dates))


def _placed(spark: SparkSession, path: str, folder: str, dates: list[str], name: str, once: bool = False) -> list[str]:
    """Rename the staged dates to loads of this name; ``once`` leaves those alone that exist."""
    placed = []
    for date in dates:
        place = f"{date}/load={name}"
        if not (once and storage.exists(spark, f"{path}/{place}")):
            storage.move(spark, f"{folder}/{date}", f"{path}/{place}")
            placed.append(place)
    storage.remove(spark, folder)
    return placed


def _write(rows: DataFrame, path: str, table: Table, load: str | None, replayed: bool) -> None:
    """Add the rows as one load; one with the name of an earlier load takes its place.

    ``replayed`` is for micro-batches, whose repetition has the same rows: dates that are in place
    stay, missing ones are added, and nothing is looked for but the dates of the batch.
    """
    spark = rows.sparkSession
    name = load or f"batch-{uuid.uuid4().hex}"
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a name for a load: {name}")
    folder, dates = _staged(rows, path, table)
    if load is None or replayed:
        _placed(spark, path, folder, dates, name, once=replayed)
        return
    state = read_state(spark, path)
    if name in state.held:
        storage.remove(spark, folder)
        raise ValueError(f"load {name} is part of merged dates and cannot be replaced")
    named = storage.matching(spark, path, "*/" * len(table.partitions) + f"load={name}*")
    earlier = [p for p in named if state.sees(p) and p.rsplit("load=", 1)[1].split("@")[0] == name]
    if not earlier:
        _placed(spark, path, folder, dates, name)
        return
    placed = _placed(spark, path, folder, dates, f"{name}@{uuid.uuid4().hex[:12]}")
    _replace(spark, path, state, placed, earlier)


def _replace(spark: SparkSession, path: str, state: State, new: Sequence[str], old: Sequence[str], **more) -> State:
    """Show the new directories and hide the old ones, in one step."""
    shown = (state.shown - set(old)) | set(new)
    return publish(spark, path, state, shown=shown, gone=state.gone | set(old), **more)


def write_lake(rows: DataFrame, path: str, load: str | None = None, replayed: bool = False) -> None:
    """Add validated rows to the ``year=/month=/day=`` lake; a named load replaces itself."""
    _write(rows, path, LAKE_TABLE, load, replayed)


def write_realtime(rows: DataFrame, path: str, load: str | None = None, replayed: bool = False) -> None:
    """Add rows to the ``event_date=`` table; a named load replaces itself."""
    _write(rows, path, REALTIME_TABLE, load, replayed)


# Reading


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    """The lake with its partition date as ``event_date``.

    ``event_date`` is computed from the partition columns alone, so a filter on it becomes a
    partition filter.
    """
    lake = visible(spark.read.schema(LAKE).parquet(path), LAKE_PARTITIONS, read_state(spark, path))
    return lake.drop("load").withColumn("event_date", F.make_date(*LAKE_PARTITIONS))


def read_realtime(
    spark: SparkSession, path: str, start: dt.datetime | None = None
) -> DataFrame:
    """The realtime table; with ``start`` only the directories of its date and later are listed.

    A stream leaves one directory per date and load until its dates are merged, so for a report on
    the last hours most of the time would go into listing the ones it does not read.
    """
    paths = [path]
    if start is not None:
        first = f"event_date={start.date().isoformat()}"
        names = [n for n in storage.child_directories(spark, path) if n.startswith("event_date=") and n >= first]
        if not names:
            return spark.createDataFrame([], REALTIME)
        paths = [f"{path}/{name}" for name in names]
    rows = spark.read.schema(REALTIME).option("basePath", path).parquet(*paths)
    return visible(rows, REALTIME_TABLE.partitions, read_state(spark, path)).drop("load")


# Completeness


def mark_complete(spark: SparkSession, path: str, first: dt.date, last: dt.date) -> None:
    """Record that the table holds these dates, both ends included, in full."""
    state = read_state(spark, path)
    publish(spark, path, state, complete=merged_ranges([*state.complete, (first, last)]))


def complete_dates(spark: SparkSession, path: str) -> tuple[Range, ...]:
    """The ranges of dates that are held in full."""
    return read_state(spark, path).complete


# Upkeep


def _load_places(spark: SparkSession, path: str, table: Table, state: State) -> dict[str, list[str]]:
    """The visible load directories of every date directory."""
    found = defaultdict(list)
    for place in sorted(storage.matching(spark, path, table.loads)):
        if state.sees(place):
            found[place.rsplit("/", 1)[0]].append(place)
    return found


def _last_batches(places: Sequence[str]) -> set[str]:
    """The names of each stream's newest batch, which may still be replayed."""
    newest: dict[str, int] = {}
    for place in places:
        if batch := _BATCH.fullmatch(place.rsplit("load=", 1)[1]):
            newest[batch[1]] = max(newest.get(batch[1], -1), int(batch[2]))
    return {f"{stream}-{number}" for stream, number in newest.items()}


def _named(places: Sequence[str]) -> set[str]:
    """Names that a later load may carry again: not those of batches of a stream or of unnamed loads."""
    names = {p.rsplit("load=", 1)[1].split("@")[0] for p in places}
    return {n for n in names if not _BATCH.fullmatch(n) and not n.startswith(("batch-", "merged"))}


def _read_places(spark: SparkSession, path: str, table: Table, places: Sequence[str]) -> DataFrame:
    reader = spark.read.schema(table.schema).option("basePath", path)
    return reader.parquet(*[f"{path}/{p}" for p in places]).drop("load")


def compact_table(
    spark: SparkSession,
    path: str,
    table: Table,
    before: dt.date,
    loads: int = 2,
    by_product: bool = False,
    **layout: str,
) -> list[str]:
    """Merge the loads of each date before ``before`` that has at least ``loads`` of them.

    One job merges all dates; late loads that arrive meanwhile are none of its inputs and stay
    visible beside the merge.  The newest batch of a stream is left out, because a replay must find
    it.  Returns the merged dates; a merge that dies before it publishes has changed nothing.

    ``by_product`` orders the merged dates for lookups by product, and takes dates of one load along
    unless that is a merge in this order; ``layout`` are further options of the Parquet writer.
    """
    name = "merged-by-product" if by_product else "merged"
    state = read_state(spark, path)
    dates = _load_places(spark, path, table, state)
    waiting = _last_batches([p for places in dates.values() for p in places])
    inputs = []
    for date, places in dates.items():
        day = table.date_of(date)
        ready = [p for p in places if p.rsplit("load=", 1)[1] not in waiting]
        if by_product:
            due = len(ready) > 1 or any(f"load={name}@" not in p for p in ready)
        else:
            due = len(ready) >= loads
        if day is not None and day < before and due:
            inputs += ready
    if not inputs:
        return []
    rows = _read_places(spark, path, table, inputs)
    folder, merged = _clustered(rows, path, table, layout) if by_product else _staged(rows, path, table)
    placed = _placed(spark, path, folder, merged, f"{name}@{uuid.uuid4().hex[:12]}")
    _replace(spark, path, state, placed, inputs, held=state.held | _named(inputs))
    return merged


def vacuum_table(spark: SparkSession, path: str, table: Table, hours: float = ABANDONED_HOURS) -> int:
    """Remove what the state hides and, once older than ``hours``, what was never published.

    Readers that began before the last change may still read hidden directories, so this runs after
    the longest of them.
    """
    state = read_state(spark, path)
    oldest = (time.time() - hours * 3600) * 1000
    stale = set(state.gone)
    for place, changed in storage.matching(spark, path, table.loads).items():
        if not state.sees(place) and place not in state.gone and changed <= oldest:
            stale.add(place)
    staged = [f"_staged/{n}" for n in storage.child_directories(spark, f"{path}/_staged")]
    changed = storage.matching(spark, path, "_staged/*") if staged else {}
    stale |= {n for n in staged if changed.get(n, 0) <= oldest}
    for place in stale:
        storage.remove(spark, f"{path}/{place}")
    if state.gone:
        publish(spark, path, state, gone=frozenset())
    forget_states(spark, path)
    return len(stale)


# Retention


def retained(events: DataFrame, as_of: dt.datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Events that have not expired: an event expires ``days`` after it happened."""
    return events.where(F.col("event_time") > instant(as_of - dt.timedelta(days=days)))


def drop_expired(
    spark: SparkSession, path: str, as_of: dt.datetime, days: int = RETENTION_DAYS
) -> list[str]:
    """Remove expired rows from the realtime table; returns the directories that went as a whole.

    The date that holds the cut-off is written anew with the rows that stay, if any row of it has
    expired.  Rows whose time is unreadable lie in the default partition and expire by when they
    were stored.
    """
    cutoff = as_of - dt.timedelta(days=days)
    names = [n for n in storage.child_directories(spark, path) if n.startswith("event_date=")]
    days_of = {n: REALTIME_TABLE.date_of(n) for n in names}
    expired = [n for n, day in days_of.items() if day is not None and day < cutoff.date()]
    for name in expired:
        storage.remove(spark, f"{path}/{name}")
    state = read_state(spark, path)
    if known := [p for p in state.shown | state.gone if p.split("/")[0] in expired]:
        publish(spark, path, state, shown=state.shown - set(known), gone=state.gone - set(known))
    _rewrite(spark, path, f"event_date={cutoff.date().isoformat()}", F.col("event_time") > instant(cutoff))
    expired += _drop_unreadable(spark, path, cutoff)
    stored = F.col("inserted_at")
    _rewrite(spark, path, f"event_date={DEFAULT_PARTITION}", stored.isNull() | (stored > instant(cutoff)))
    return expired


def _drop_unreadable(spark: SparkSession, path: str, cutoff: dt.datetime) -> list[str]:
    """Remove the loads of rows without a date of which all were stored before the cut-off."""
    state, date = read_state(spark, path), f"event_date={DEFAULT_PARTITION}"
    loads = [n for n in storage.child_directories(spark, f"{path}/{date}") if state.sees(f"{date}/{n}")]
    if not loads:
        return []
    rows = spark.read.schema(REALTIME).option("basePath", path).parquet(*[f"{path}/{date}/{n}" for n in loads])
    newest = rows.groupBy("load").agg(F.max("inserted_at").alias("newest"), F.count_if(F.col("inserted_at").isNull()).alias("unknown"))
    old = newest.where((F.col("newest") < instant(cutoff)) & (F.col("unknown") == 0)).select("load").collect()
    names = sorted(f"{date}/load={row.load}" for row in old)
    for name in names:
        storage.remove(spark, f"{path}/{name}")
    return names


def _rewrite(spark: SparkSession, path: str, date: str, stays: Column) -> bool:
    """Replace the loads of one date by their rows that stay; does nothing if all do."""
    state = read_state(spark, path)
    places = [f"{date}/{n}" for n in storage.child_directories(spark, f"{path}/{date}")]
    places = [p for p in places if state.sees(p)]
    if not places:
        return False
    rows = _read_places(spark, path, REALTIME_TABLE, places)
    if rows.where(~F.coalesce(stays, F.lit(False))).isEmpty():
        return False
    folder, dates = _staged(rows.where(stays), path, REALTIME_TABLE)
    placed = _placed(spark, path, folder, dates, f"merged@{uuid.uuid4().hex[:12]}")
    _replace(spark, path, state, placed, places, held=state.held | _named(places))
    return True
