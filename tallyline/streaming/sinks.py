"""The two stream sinks: validated lake rows and the realtime table.

Each has its own checkpoint.  A live stream fires every 30 seconds; a daily run or a test takes
what is there and ends, so two runs never share a checkpoint at the same time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyline.operators import ingest
from tallyline.sources import tables

LIVE_INTERVAL = "30 seconds"


def trigger(live: bool) -> dict:
    return {"processingTime": LIVE_INTERVAL} if live else {"availableNow": True}


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity a stream keeps over restarts; a new checkpoint is another stream."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def _start(
    messages: DataFrame,
    checkpoint: str,
    live: bool,
    write: Callable[[DataFrame, str], None],
) -> StreamingQuery:
    """``write`` each micro-batch as a load named after stream and batch, so that a replay after a
    failure finds what it had written and adds only what is missing."""
    known: list[str] = []

    def store(batch: DataFrame, batch_id: int) -> None:
        if not known:
            known.append(stream_id(batch.sparkSession, checkpoint))
        write(batch, f"{known[0]}-{batch_id}")

    return (
        messages.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(live))
        .start()
    )


def start_lake_sink(
    messages: DataFrame, path: str, checkpoint: str, live: bool = False
) -> StreamingQuery:
    """Parse, enrich and validate into the lake, exactly once and next to what batches wrote."""
    return _start(
        messages,
        checkpoint,
        live,
        lambda batch, load: tables.write_lake(ingest.lake_rows(batch), path, load, replayed=True),
    )


def start_realtime_sink(
    messages: DataFrame, path: str, checkpoint: str, live: bool = False
) -> StreamingQuery:
    """Parse into the realtime table with an ingest stamp."""
    return _start(
        messages,
        checkpoint,
        live,
        lambda batch, load: tables.write_realtime(
            ingest.realtime_rows(batch), path, load, replayed=True
        ),
    )
