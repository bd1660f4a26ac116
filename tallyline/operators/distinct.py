"""Exact distinct counts that can be added up: bitmaps of dictionary codes.

A dictionary gives each value of a column a number, from 0 without gaps; numbers are never changed, so
bitmaps of different days and loads can be united.  Per date and 32,768 numbers there is one bitmap of
4 KB.  Storing a day twice changes nothing, because uniting is idempotent.

Layout below a root, per column: ``<column>/codes/`` and ``<column>/days/``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.sources import storage

CODES, DAYS = "value string, code long", "date date, bucket long, bitmap binary"
#: Groups in which new values are numbered apart, so that no task numbers all of them.
GROUPS = 256


def read_codes(spark: SparkSession, root: str, column: str) -> DataFrame:
    path = f"{root}/{column}/codes"
    return spark.read.schema(CODES).parquet(path) if storage.exists(spark, path) else spark.createDataFrame([], CODES)


def extend_codes(events: DataFrame, root: str, column: str) -> None:
    """Number the values of the column that have no number yet.  One writer at a time."""
    spark = events.sparkSession
    known = read_codes(spark, root, column)
    values = events.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    new = values.join(known, "value", "left_anti").withColumn("group", F.pmod(F.xxhash64("value"), F.lit(GROUPS)))
    sizes = new.groupBy("group").agg(F.count("*").alias("size"))
    first = sizes.select("group", (F.sum("size").over(Window.orderBy("group")) - F.col("size")).alias("first"))
    start = known.agg(F.coalesce(F.max("code") + 1, F.lit(0)).alias("start")).first().start
    within = F.row_number().over(Window.partitionBy("group").orderBy("value")) - 1
    coded = new.withColumn("within", within).join(first, "group")
    code = (F.lit(start) + F.col("first") + F.col("within")).alias("code")
    coded.select("value", code).write.mode("append").parquet(f"{root}/{column}/codes")


def _coded(events: DataFrame, codes: DataFrame, column: str, *keys: str) -> DataFrame:
    """Different values per key with their code; none for values without one."""
    values = events.select(*keys, F.col(column).cast("string").alias("value")).where("value IS NOT NULL")
    return values.distinct().join(codes, "value", "left")


def _bitmaps(coded: DataFrame, *keys: str) -> DataFrame:
    bucket = F.bitmap_bucket_number("code").alias("bucket")
    return coded.groupBy(*keys, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bitmap"))


def store_days(events: DataFrame, root: str, column: str) -> None:
    """Add the bitmaps of the dates of these events."""
    extend_codes(events, root, column)
    codes = read_codes(events.sparkSession, root, column)
    dated = events.withColumn("date", F.to_date("event_time"))
    _bitmaps(_coded(dated, codes, column, "date"), "date").write.mode("append").parquet(f"{root}/{column}/days")


def distinct_count(
    spark: SparkSession, root: str, column: str, tail: DataFrame | None = None, dates: str | None = None
) -> DataFrame:
    """(n): different values in the stored days (with ``dates``, a condition on ``date``) and the tail.

    Values of the tail that the dictionary does not know are in no bitmap and are counted beside them.
    """
    days = spark.read.schema(DAYS).parquet(f"{root}/{column}/days")
    days = (days.where(dates) if dates else days).select("bucket", "bitmap")
    unknown = None
    if tail is not None:
        coded = _coded(tail, read_codes(spark, root, column), column)
        days = days.unionByName(_bitmaps(coded.where("code IS NOT NULL")))
        unknown = coded.where("code IS NULL").agg(F.count("*").alias("n"))
    united = days.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n")).select("n")
    counted = united if unknown is None else united.unionByName(unknown)
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
