import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyline.schemas import EVENT_COLUMNS  # noqa: E402
from tallyline.session import build_session  # noqa: E402

SF_TINY = "/root/testdata/sf0.001"
SF_SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
        spark__sql__maxMetadataStringLength="10000",
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture()
def events(spark):
    """Events from tuples; a missing tail takes the defaults below."""

    def make(*rows):
        defaults = ("2024-01-31 12:00:00", 1, "P00", "C0", "SALE", 1, 1.0)
        full = [tuple(row) + defaults[len(row) :] for row in rows]
        schema = (
            "event_time STRING, store_id INT, product_id STRING, category STRING, "
            "transaction_type STRING, quantity INT, unit_price DOUBLE"
        )
        frame = spark.createDataFrame(full, schema)
        return frame.withColumn("event_time", frame.event_time.cast("timestamp")).select(
            *EVENT_COLUMNS
        )

    return make


@pytest.fixture()
def at():
    return lambda text: dt.datetime.fromisoformat(text)


