"""What readers of a stored table see: the published state of its directories.

A table's data lie in ``<date parts>/load=<name>`` directories.  Most become visible by standing
there.  A directory that takes the place of others (a merge, a load repeated with other rows, a date
without its expired rows) has an ``@`` in its name and is hidden until the state shows it; in the same
step the state hides what it replaces.  A state is one small file below ``_state``, numbered upwards
and never changed, so a change of any number of dates is seen as a whole or not at all, and work that
dies before it publishes has changed nothing.

The state also tells which dates the table holds in full (``complete``), and which named loads have
been merged away (``held``).  Two writers that publish at the same time: the second one fails and may
be run again.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.sources import storage

DEFAULT_PARTITION = "__HIVE_DEFAULT_PARTITION__"
#: Newest states kept by :func:`forget_states`.
KEPT_STATES = 5

Range = tuple[dt.date, dt.date]


@dataclass(frozen=True)
class State:
    number: int = 0
    shown: frozenset[str] = frozenset()
    gone: frozenset[str] = frozenset()
    held: frozenset[str] = frozenset()
    complete: tuple[Range, ...] = field(default=())

    def sees(self, place: str) -> bool:
        return place not in self.gone and ("@" not in place or place in self.shown)


def _numbers(spark: SparkSession, root: str) -> list[int]:
    names = storage.child_files(spark, f"{root}/_state")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def read_state(spark: SparkSession, root: str) -> State:
    """The newest state.  One whose writer died half-way cannot be parsed and never counted."""
    for number in reversed(_numbers(spark, root)):
        try:
            found = json.loads(storage.read_text(spark, f"{root}/_state/{number}.json"))
        except ValueError:
            continue
        days = [(dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for a, b in found["complete"]]
        return State(number, *(frozenset(found[k]) for k in ("shown", "gone", "held")), tuple(days))
    return State()


def publish(spark: SparkSession, root: str, seen: State, **changes) -> State:
    """Make ``changes`` to the state that was ``seen``; fails if it is no longer the newest."""
    numbers = _numbers(spark, root)
    if read_state(spark, root).number != seen.number:
        raise RuntimeError(f"the state of {root} has changed; read it again")
    new = replace(seen, **changes, number=max([seen.number, *numbers]) + 1)
    text = json.dumps(
        {
            **{k: sorted(getattr(new, k)) for k in ("shown", "gone", "held")},
            "complete": [[a.isoformat(), b.isoformat()] for a, b in new.complete],
        }
    )
    storage.create_text(spark, f"{root}/_state/{new.number}.json", text)
    return new


def forget_states(spark: SparkSession, root: str) -> None:
    for number in _numbers(spark, root)[:-KEPT_STATES]:
        storage.remove(spark, f"{root}/_state/{number}.json")


def place_of(partitions: Sequence[str]) -> Column:
    """The directory of a row below the root, as text made of partition columns alone."""
    parts = [
        F.concat(F.lit(f"{p}="), F.coalesce(F.col(p).cast("string"), F.lit(DEFAULT_PARTITION)))
        for p in [*partitions, "load"]
    ]
    return F.concat_ws("/", *parts)


def visible(rows: DataFrame, partitions: Sequence[str], state: State) -> DataFrame:
    """The rows of visible directories: a filter on partition columns, so others are not read."""
    if "load" not in rows.columns:  # a table without any directory
        return rows
    hidden = F.col("load").contains("@")
    if state.shown:
        hidden = hidden & ~place_of(partitions).isin(*state.shown)
    kept = rows.where(~hidden)
    return kept.where(~place_of(partitions).isin(*state.gone)) if state.gone else kept


def merged_ranges(ranges: Iterable[Range]) -> tuple[Range, ...]:
    """Ranges of dates, both ends included, joined where they touch."""
    joined: list[Range] = []
    for first, last in sorted(r for r in ranges if r[0] <= r[1]):
        if joined and first <= joined[-1][1] + dt.timedelta(days=1):
            joined[-1] = (joined[-1][0], max(joined[-1][1], last))
        else:
            joined.append((first, last))
    return tuple(joined)
