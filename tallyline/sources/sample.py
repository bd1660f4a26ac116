"""Relations derived from the supplied tables, in the shapes the reports expect.

``events`` becomes the store-event relation, ``lineitem`` a larger one of the same shape, and the
store events give a deterministic forecast table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.ingest import encode
from tallyline.plans.serving import combine_layers
from tallyline.schemas import RESTOCK, RETURN, SALE

AS_OF = dt.datetime(2024, 1, 31)
CUTOVER = dt.datetime(2024, 1, 24)
LINEITEM_AS_OF = dt.datetime(2001, 11, 5)
VERSIONS = {"fixture_v1": 1.0, "fixture_v2": 0.5}


# The stored columns.  A given schema saves a job that would read it from the files.
EVENTS_TABLE = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)
LINEITEM_TABLE = (
    "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
    "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
)


def _product(number: str) -> str:
    return f"concat('P', lpad(CAST({number} % 25 AS STRING), 2, '0')) AS product_id"


def _category(number: str) -> str:
    return f"concat('C', CAST({number} % 25 DIV 5 AS STRING)) AS category"


def store_events(
    spark: SparkSession,
    sf_dir: str,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> DataFrame:
    """Store events from ``events``.

    ``start`` and ``end`` bound the stored ``ts`` itself, because the second-precision
    ``event_time`` computed from it cannot be pushed to the scan.
    """
    raw = spark.read.schema(EVENTS_TABLE).parquet(f"{sf_dir}/events.parquet")
    if start is not None:
        raw = raw.where(f"ts >= TIMESTAMP_NTZ '{start:%Y-%m-%d %H:%M:%S}'")
    if end is not None:
        raw = raw.where(f"ts < TIMESTAMP_NTZ '{end:%Y-%m-%d %H:%M:%S}'")
    return as_store_events(raw)


def message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table read as a stream of JSON messages.

    A stream's path must be a directory or a pattern, and the table may be a single file.
    """
    raw = spark.readStream.schema(EVENTS_TABLE).parquet(f"{sf_dir}/events*.parquet")
    return encode(as_store_events(raw))


def as_store_events(raw: DataFrame) -> DataFrame:
    # ``k`` is nearly always the only key; cutting it out costs a tenth of parsing the JSON.
    cut = "try_cast(substring(props, 6, length(props) - 6) AS INT)"
    number = f"""coalesce(
        if(startswith(props, '{{"k":') AND endswith(props, '}}') AND NOT contains(props, ','), {cut}, NULL),
        CAST(get_json_object(props, '$.k') AS INT))"""
    return raw.selectExpr(
        "event_id",
        "date_trunc('second', ts) AS event_time",
        "CAST(user_id % 10 + 1 AS INT) AS store_id",
        _product(number),
        _category(number),
        f"""CASE event_type WHEN 'error' THEN '{RETURN}' WHEN 'signup' THEN '{RESTOCK}'
            ELSE '{SALE}' END AS transaction_type""",
        """CAST(CASE event_type WHEN 'error' THEN 1 + event_id % 5
            WHEN 'signup' THEN 10 + event_id % 91
            ELSE 1 + event_id % 10 END AS INT) AS quantity""",
        "value AS unit_price",
        "date_trunc('second', ts + INTERVAL 5 SECONDS) AS inserted_at",
    )


def unified(spark: SparkSession, sf_dir: str, days: int | None = None) -> DataFrame:
    """Both layers, cut over at :data:`CUTOVER`; with ``days`` only that many before AS_OF."""
    start = None if days is None else AS_OF - dt.timedelta(days=days)
    recent_from = CUTOVER if start is None else max(start, CUTOVER)
    recent = store_events(spark, sf_dir, start=recent_from)
    archived = store_events(spark, sf_dir, start=start, end=CUTOVER)
    return combine_layers(recent, archived, CUTOVER)


def lineitem_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store events from ``lineitem``, six times as many rows; no unique key."""
    raw = spark.read.schema(LINEITEM_TABLE).parquet(f"{sf_dir}/lineitem.parquet")
    return raw.selectExpr(
        "CAST(l_shipdate AS TIMESTAMP) + make_interval(0, 0, 0, 0, CAST(l_orderkey % 24 AS INT))"
        " AS event_time",
        "CAST(l_suppkey % 10 + 1 AS INT) AS store_id",
        _product("l_partkey"),
        _category("l_partkey"),
        f"""CASE WHEN l_returnflag <> 'R' THEN '{SALE}' WHEN l_linestatus = 'F' THEN '{RETURN}'
            ELSE '{RESTOCK}' END AS transaction_type""",
        "CAST(l_quantity AS INT) AS quantity",
        "l_extendedprice AS unit_price",
    )


def predictions(spark: SparkSession, sf_dir: str, *versions: str) -> DataFrame:
    """A forecast for every product and store seen before the cut-over, seven days by the hour.

    The demand is a fixed function of past sales whose values are exact in binary.
    """
    weekdays = (
        store_events(spark, sf_dir, end=CUTOVER)
        .groupBy("product_id", "store_id", F.expr("weekday(event_time) + 1 AS weekday"))
        .agg(F.expr(f"sum(if(transaction_type = '{SALE}', quantity, 0)) AS q"))
    )
    last = CUTOVER + dt.timedelta(days=7, hours=-1)
    slots = (
        weekdays.groupBy("product_id", "store_id")
        .agg(F.expr("map_from_entries(collect_list(struct(weekday, q))) AS sold"))
        .selectExpr(
            "*",
            f"""explode(sequence(TIMESTAMP '{CUTOVER}', TIMESTAMP '{last}', INTERVAL 1 HOUR))
                AS slot""",
        )
        .selectExpr("*", "weekday(slot) + 1 AS day_of_week")
    )
    factors = ", ".join(
        f"struct('{v}' AS model_version, {VERSIONS[v]}D AS factor)" for v in versions or VERSIONS
    )
    rows = (
        slots.selectExpr(
            "*",
            "hour(slot) AS forecast_hour",
            "to_date(slot) AS forecast_date",
            "month(slot) AS month",
            """(1 + coalesce(try_element_at(sold, day_of_week), 0) % 16) / 32 * (1 + hour(slot) % 2) *
               CASE CAST(substring(product_id, 2, 2) AS INT) % 3
               WHEN 0 THEN 8 WHEN 1 THEN 3 ELSE 2 END / 8 AS demand""",
            f"inline(array({factors}))",
        )
        .withColumn("predicted_demand", F.expr("demand * factor"))
    )
    key = "model_version, product_id, store_id, forecast_date, forecast_hour"
    return rows.selectExpr(
        f"sha2(concat_ws('|', {key}), 256) AS prediction_id",
        f"TIMESTAMP '{CUTOVER}' AS prediction_time",
        *key.split(", "),
        "predicted_demand",
        "CAST(round(CAST(predicted_demand * 0.8D AS DECIMAL(18,6)), 2) AS DOUBLE) AS confidence_lower",
        "CAST(round(CAST(predicted_demand * 1.2D AS DECIMAL(18,6)), 2) AS DOUBLE) AS confidence_upper",
        "day_of_week",
        "month",
        "CASE WHEN day_of_week >= 6 THEN 1 ELSE 0 END AS is_weekend",
        "CASE WHEN month IN (11, 12) THEN 1.5D WHEN month IN (6, 7, 8) THEN 1.1D ELSE 1.0D END"
        " AS seasonal_factor",
        f"TIMESTAMP '{CUTOVER}' AS created_at",
    )
