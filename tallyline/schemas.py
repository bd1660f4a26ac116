"""Schemas of the relations (fixed values: column names, order and types)."""

from pyspark.sql import types as T

SALE, RETURN, RESTOCK = "SALE", "RETURN", "RESTOCK"

# One JSON message; event_time is still text.
MESSAGE = T.StructType(
    [
        T.StructField("event_time", T.StringType()),
        T.StructField("store_id", T.IntegerType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("unit_price", T.DoubleType()),
    ]
)

EVENT = T.StructType([T.StructField("event_time", T.TimestampType())] + MESSAGE.fields[1:])
EVENT_COLUMNS = EVENT.fieldNames()

REALTIME = T.StructType(
    EVENT.fields
    + [
        T.StructField("inserted_at", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
    ]
)

LAKE = T.StructType(
    EVENT.fields
    + [
        T.StructField("revenue", T.DoubleType()),
        T.StructField("hour_of_day", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("is_weekend", T.BooleanType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
    ]
)
LAKE_PARTITIONS = ["year", "month", "day"]

PREDICTION_FILE = T.StructType(
    [
        T.StructField("prediction_id", T.StringType()),
        T.StructField("prediction_time", T.TimestampType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("store_id", T.IntegerType()),
        T.StructField("forecast_date", T.DateType()),
        T.StructField("forecast_hour", T.IntegerType()),
        T.StructField("predicted_demand", T.DoubleType()),
        T.StructField("confidence_lower", T.DoubleType()),
        T.StructField("confidence_upper", T.DoubleType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("is_weekend", T.IntegerType()),
        T.StructField("seasonal_factor", T.DoubleType()),
    ]
)

DEMAND_PREDICTIONS = T.StructType(
    PREDICTION_FILE.fields + [T.StructField("created_at", T.TimestampType())]
)

MODEL_METRICS = T.StructType(
    [
        T.StructField("metric_id", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("training_date", T.TimestampType()),
        T.StructField("training_samples", T.LongType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("r2_score", T.DoubleType()),
        T.StructField("parameters", T.StringType()),
        T.StructField("is_active", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
