"""Places of rows in a Parquet table, and joins by them that do not move the rows.

The place of a row is its file and its number in it.  What was found out about some rows, as a table of
(file, row, ...), goes back to them by broadcast, in rounds: each covers a range of places with a bounded
number of found rows, and reads the files of its range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm import common
from tallyline.session import scratch_path

#: Found rows broadcast at once (at most some 300 bytes each), and rows of a file that a cut keeps together.
ROUND, BLOCK_BITS = 200_000, 17

Bound = tuple[str, int] | None


def placed(rows: DataFrame) -> DataFrame:
    """The rows if they are a Parquet table as it was read, else the rows written as one."""
    plan = rows._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().fileFormat().toString() == "Parquet":
        return rows
    return common.stored(rows, "rows")


def place_of(rows: DataFrame) -> tuple[Column, Column]:
    """File and row number, whatever the columns of the rows are called."""
    metadata = rows.metadataColumn("_metadata")
    return metadata["file_path"], metadata["row_index"]


def rounds(found: DataFrame, limit: int = ROUND) -> list[tuple[Bound, Bound]]:
    """Ranges of places, (first, end) with none for an open end, each with at most ``limit`` found rows.

    The driver sees one number per block of rows of a file in which something was found."""
    bits = block_bits(limit)
    blocks = found.groupBy("file", F.shiftright("row", bits).alias("block")).count().orderBy("file", "block")
    cuts, total = [], 0
    for block in blocks.toLocalIterator():
        if total + block["count"] > limit:
            cuts.append((block["file"], block["block"]))
            total = 0
        total += block["count"]
    return list(zip([None, *cuts], [*cuts, None]))


def block_bits(limit: int) -> int:
    """A block has no more rows than a round may find."""
    return min(BLOCK_BITS, limit.bit_length() - 1)


def within(rows: DataFrame, file: Column, row: Column, first: Bound, end: Bound, limit: int = ROUND) -> DataFrame:
    """Rows of one range; the plain comparison of the file lets the scan skip files."""
    place = F.struct(file, F.shiftright(row, block_bits(limit)).cast("long"))
    bound = lambda at: F.struct(F.lit(at[0]), F.lit(at[1]).cast("long"))
    if first:
        rows = rows.filter((file >= first[0]) & (place >= bound(first)))
    if end:
        rows = rows.filter((file <= end[0]) & (place < bound(end)))
    return rows


def without(rows: DataFrame, dropped: DataFrame, limit: int = ROUND) -> DataFrame:
    """The rows of a placed table but those at the places ``dropped``; several rounds are written one by one."""
    file, row = place_of(rows)

    def left(first: Bound, end: Bound) -> DataFrame:
        known = F.broadcast(within(dropped, dropped["file"], dropped["row"], first, end, limit))
        same = (file == known["file"]) & (row == known["row"])
        return within(rows, file, row, first, end, limit).join(known, same, "left_anti")

    ranges = rounds(dropped, limit)
    if len(ranges) == 1:
        return left(*ranges[0])
    path = scratch_path(rows.sparkSession, "left")
    for first, end in ranges:
        left(first, end).write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
