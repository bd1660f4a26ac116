"""What the operators share: reading tables, tables written between stages, folds, worker batches."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.session import scratch_path

#: Characters that end a word: the pattern ``[\x20\x09-\x0D]``.
WORD_END = " \t\n\x0b\f\r"
#: Bytes of text handled at once inside a Python task, so that long texts do not add up.
SLICE = 4 << 20
#: Words a worker remembers; a cache, without influence on results.
CACHE_WORDS = 700_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows written below ``spark.checkpoint.dir`` and read again: cuts the lineage, and work
    above it is not repeated when an executor is lost."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    kept = rows.sparkSession.read.schema(rows.schema).parquet(path)
    kept.stored_at = path
    return kept


def discard(rows: DataFrame) -> None:
    """Delete a table of :func:`stored` that nothing reads any more."""
    path = getattr(rows, "stored_at", None)
    if path:
        jvm, spark = rows.sparkSession._jvm, rows.sparkSession
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fold(key: Column, parts: int) -> Column:
    """``crc32`` of the key as text, modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def give_back() -> None:
    """Return freed memory, which Arrow and the C library keep for themselves, to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows in parts of about ``size`` bytes of one text or binary column, one row at least.

    Freed memory is given back after each batch, so that a worker between tasks holds its caches and
    no more; and at first, with what earlier stages built, which Spark has dropped by now but which
    only the collector frees, since caches and their owners refer to each other."""
    gc.collect()
    give_back()
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        parts = np.cumsum(lengths, dtype=np.int64) // size
        starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if batch.num_rows else []
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)
        give_back()


class Words:
    """The words of a slice of texts: per text how many, per word its number, and each word once."""

    def __init__(self, texts: pa.Array, space_only: bool = False):
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(texts, " ") if space_only else pc.ascii_split_whitespace(texts)
        self.counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.different = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self.text = np.repeat(np.arange(self.counts.size), self.counts)


class Runs:
    """Runs of values, one after the other, in arrays that grow by doubling."""

    def __init__(self):
        self.values, self.used = None, 0
        self.starts, self.counts, self.number = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        if self.values is None:
            self.values = np.empty((0, *values.shape[1:]), values.dtype)
        ends = self.used + np.cumsum(counts)
        self.values = _with(self.values, self.used, values)
        self.starts = _with(self.starts, self.number, ends - counts)
        self.counts = _with(self.counts, self.number, counts)
        self.used, self.number = self.used + len(values), self.number + len(counts)

    def take(self, numbers: np.ndarray) -> np.ndarray:
        return gathered(self.values, self.starts[numbers], self.counts[numbers])


def _with(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The array with ``more`` behind its first ``used`` elements."""
    if used + len(more) > len(array):
        larger = np.empty((max(2 * len(array), used + len(more)), *array.shape[1:]), array.dtype)
        larger[:used] = array[:used]
        array = larger
    array[used : used + len(more)] = more
    return array


class Pool:
    """Numbers of words already met by a worker and, for each, a run of values in one flat array.

    Words lie in two generations: a full one becomes the older, whose words move over when they are
    met again, so at most ``limit`` words and those of one call are held and frequent ones stay.

    ``learn`` gives the values of words and how many each has, and may add a list with a note on each."""

    def __init__(self, learn: Callable[[list[bytes]], tuple], limit: int):
        self.learn, self.limit = learn, limit
        self.number: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.runs, self.older_runs = Runs(), Runs()
        self.notes, self.older_notes = [], []

    @property
    def counts(self) -> np.ndarray:
        return self.runs.counts

    @property
    def values(self) -> np.ndarray:
        return self.runs.values

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words, after learning the new ones.  They hold until the next call."""
        if len(self.number) > self.limit // 2:
            self.older, self.older_runs, self.older_notes = self.number, self.runs, self.notes
            self.number, self.runs, self.notes = {}, Runs(), []
        number = self.number
        out = _looked_up(number, words)
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            new = list(dict.fromkeys([words[i] for i in missing]))
            at = _looked_up(self.older, new)
            met = at >= 0
            if met.any():
                here = at[met]
                notes = [self.older_notes[i] for i in here.tolist()] if self.older_notes else []
                self.add([new[i] for i in np.flatnonzero(met).tolist()], self.older_runs.take(here), self.older_runs.counts[here], notes)
            unknown = [new[i] for i in np.flatnonzero(~met).tolist()]
            if unknown:
                self.add(unknown, *self.learn(unknown))
            out[missing] = [number[words[i]] for i in missing]
        return out

    def add(self, words: list[bytes], values: np.ndarray, counts: np.ndarray, notes: list = ()) -> None:
        known = len(self.number)
        self.notes += notes
        self.number.update(zip(words, range(known, known + len(words))))
        self.runs.add(values, counts)

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The values of these words, one word after the other."""
        return self.runs.take(numbers)


def _looked_up(number: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    """The numbers of words, -1 for those without one."""
    return np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))


def of_worker(sent, make: Callable):
    """What ``make`` builds of a broadcast value, once in each worker process.

    A worker keeps the broadcast object over its tasks, so what was built of it lives there too."""
    if not hasattr(sent, "built"):
        sent.built = make(sent.value)
    return sent.built


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of ``values``, joined."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if ends.size else 0
    return values[np.repeat(starts - ends + counts, counts) + np.arange(total)] if total else values[:0] if values is not None else np.zeros(0, np.int64)


def sampled(rows: DataFrame, key: Column, limit: int, counted: int) -> DataFrame:
    """About ``limit`` of ``counted`` rows, at most 1.2 times as many, chosen by a hash of the key."""
    if counted > limit:
        share = int(limit / counted * 1_000_000)
        rows = rows.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < max(share, 1))
    return rows.limit(int(1.2 * limit))
