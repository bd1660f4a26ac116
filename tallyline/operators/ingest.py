"""Message → event → enriched event → valid or rejected.

The same functions serve the batch job and both streams: they are projections and filters only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import calendar
from tallyline.schemas import EVENT_COLUMNS, LAKE, MESSAGE

STRICT_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Text forms tried in this order once the plain cast (ISO forms) has failed.
LENIENT_FORMATS = (
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy",
    "dd-MM-yyyy HH:mm:ss",
    "dd.MM.yyyy HH:mm:ss",
    "d MMM yyyy HH:mm:ss",
    "MMM d yyyy HH:mm:ss",
    "yyyyMMddHHmmss",
    "yyyyMMdd",
)


def strict_time(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` or null."""
    return F.try_to_timestamp(text, F.lit(STRICT_FORMAT))


def lenient_time(text: Column) -> Column:
    """The first reading that fits, cut to whole seconds; null when none does.

    A run of nine or ten digits is a Unix time in seconds, thirteen digits one in milliseconds.
    """
    seconds = F.when(text.rlike(r"^\d{9,10}$"), F.timestamp_seconds(text.try_cast("bigint")))
    millis = F.when(text.rlike(r"^\d{13}$"), F.timestamp_millis(text.try_cast("bigint")))
    iso = F.when(text.rlike(r"^\d{4}-"), text.try_cast("timestamp"))
    others = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in LENIENT_FORMATS]
    return F.date_trunc("second", F.coalesce(iso, seconds, millis, *others))


def decode(messages: DataFrame) -> DataFrame:
    """JSON ``value`` → the seven fields as text or numbers; a malformed message is all null.

    A generator, unlike a projection, is not merged into the filters and columns above it, so each
    message is parsed once and not once per use of a field.
    """
    text = F.col("value").cast("string")
    return messages.select("value", F.inline(F.array(F.from_json(text, MESSAGE))))


def parse_events(messages: DataFrame, lenient: bool = False) -> DataFrame:
    read_time = lenient_time if lenient else strict_time
    return decode(messages).withColumn("event_time", read_time(F.col("event_time")))


def enrich(events: DataFrame) -> DataFrame:
    """Revenue and calendar columns of the lake table (``day_of_week`` 1 = Sunday there)."""
    time = F.col("event_time")
    return events.withColumns(
        {
            "revenue": F.col("quantity") * F.col("unit_price"),
            "hour_of_day": F.hour(time),
            "day_of_week": F.dayofweek(time),
            "is_weekend": calendar.is_weekend(time),
            "year": F.year(time),
            "month": F.month(time),
            "day": F.dayofmonth(time),
        }
    )


def reject_reason() -> Column:
    """Why an enriched event is not valid; null for a valid one."""
    fields = [F.col(name).isNull() for name in EVENT_COLUMNS]
    nothing_read = fields[0]
    for missing in fields[1:]:
        nothing_read = nothing_read & missing
    reason = F.when(nothing_read, "unreadable")
    for name in ("quantity", "unit_price", "revenue"):
        reason = reason.when(F.col(name).isNull(), f"missing {name}")
        reason = reason.when(F.col(name) <= 0, f"non-positive {name}")
    return reason


def valid_events(enriched: DataFrame) -> DataFrame:
    """Positive quantity, price and revenue; nulls drop out."""
    return enriched.where(
        (F.col("quantity") > 0) & (F.col("unit_price") > 0) & (F.col("revenue") > 0)
    )


def rejected_events(enriched: DataFrame) -> DataFrame:
    """The complement of :func:`valid_events`, each row with its reason."""
    return enriched.withColumn("reason", reject_reason()).where(F.col("reason").isNotNull())


def lake_rows(messages: DataFrame) -> DataFrame:
    """What the lake sink stores."""
    return valid_events(enrich(parse_events(messages))).select(*LAKE.fieldNames())


def realtime_rows(messages: DataFrame) -> DataFrame:
    """What the realtime table stores: no validation, an ingest stamp and its date partition."""
    events = parse_events(messages, lenient=True)
    return events.select(
        *EVENT_COLUMNS,
        F.date_trunc("second", F.current_timestamp()).alias("inserted_at"),
        F.to_date("event_time").alias("event_date"),
    )


def encode(events: DataFrame, *more: str) -> DataFrame:
    """Events → JSON text in ``value``, the wire form of a topic or, with ``more`` columns, an export."""
    time = F.date_format("event_time", STRICT_FORMAT).alias("event_time")
    return events.select(F.to_json(F.struct(time, *EVENT_COLUMNS[1:], *more)).alias("value"))
