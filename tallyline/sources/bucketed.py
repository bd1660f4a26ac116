"""Tables whose rows are dealt to buckets by key when they are written, so that joins on the key need
no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

BUCKETS = 256


def write_bucketed(
    rows: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int = BUCKETS, **layout: str
) -> DataFrame:
    """Replace the catalog table ``table``, stored at ``path``, and return it.

    One exchange deals rows to tasks as to buckets, so a bucket is one sorted file.  Tables to be
    joined need the same keys and count; choose keys that no third of the rows share, since a bucket
    is read by one task.
    """
    (
        rows.repartition(buckets, *keys)
        .write.bucketBy(buckets, *keys)
        .sortBy(*keys)
        .options(path=path, **layout)
        .mode("overwrite")
        .saveAsTable(table)
    )
    return rows.sparkSession.table(table)
