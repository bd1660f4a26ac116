"""Packing documents into sequences in the order of a space-filling curve.

Each document becomes ids, and its ids a hashed count vector, scaled to unit length and projected to
four dimensions; the cell it falls into has a place on a Hilbert curve.  The tokenised documents are
written once, range-partitioned and sorted by (place, doc_id), and every partition is cut into
sequences of 2048 ids along the curve, so that neighbouring documents share sequences.  What is left
at the end of a partition is cut at powers of two and needs no padding.

Equal documents have equal places; ``doc_id`` is part of the sort key and of the partition bounds,
so a large group of copies is spread over partitions.  A task holds one batch of rows at a time.

Defined results: a null text is an empty one and consists of the end id alone, as does a text without
tokens.  Repeated rows are packed each by themselves.  An empty table gives an empty result; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm import common
from tallyline.llm.bpe import Merges, _nothing, joined, read_vocabulary

LENGTH = 2048
#: Bytes of text encoded at once.  An id and what is made of it take some 60 bytes for a moment.
ENCODED = 3 << 19
END_ID = 1
#: Hashed vector size, dimensions it is projected to, and bits of a cell number in each.
HASHED, DIMENSIONS, BITS = 64, 4, 10

PIECES = T.StructType(
    [
        T.StructField(name, T.LongType())
        for name in "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()
    ]
)
TOKENISED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("place", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells, rows of ``cells``, on the Hilbert curve (Skilling's transposition)."""
    x = cells.T.astype(np.int64).copy()
    dims, top = x.shape[0], 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            set_ = (x[i] & q) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        flip ^= np.where((x[dims - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    place = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


class WordCodec:
    """Ids of texts, by encoding each different word once.

    Words here are runs without ASCII white space.  The tokenizer drops white space and never joins
    what it separates, so a text's ids are those of its words one after the other.  Words of
    printable ASCII and Latin letters go through batched merges, all others through the library.
    """

    #: Fixed value: the pre-tokenisation pattern of the vocabulary file.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Words of printable ASCII and Latin letters.
    SIMPLE = r"^[!-~\x{c0}-\x{24f}]+$"

    def __init__(self, vocabulary: bytes, cached: int = common.CACHE_WORDS):
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if pattern != self.PIECES or spec["normalizer"]["normalizers"][-1]["type"] != "Lowercase":
            raise ValueError("not a vocabulary of lower-case words with word ends")
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.find = regex.compile(self.PIECES + r"|\n").findall
        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pool = common.Pool(self.learn, cached)

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = pa.array(words, pa.binary()).cast(pa.string())
        simple = pc.match_substring_regex(texts, self.SIMPLE).to_numpy(zero_copy_only=False)
        simple &= ~pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        here, rest = np.flatnonzero(simple), np.flatnonzero(~simple)
        # A word of letters alone is one piece.
        lower = "\n".join(_strings(texts.take(here))).lower().split("\n") if here.size else []
        lower = pa.array(lower, pa.string())
        letters = pc.match_substring_regex(lower, r"^\p{L}+$").to_numpy(zero_copy_only=False)
        whole, mixed = lower.filter(letters), lower.filter(~letters)
        some = self.merges.encode(
            np.frombuffer("".join(_strings(whole)).encode(), np.uint8),
            pc.binary_length(whole).to_numpy(zero_copy_only=False).astype(np.int64),
        )
        found = self.find("\n".join(_strings(mixed))) if len(mixed) else []
        more = self.merges.encode_found(found, " ", "\n") if found else _nothing()
        others = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in _strings(texts.take(rest))]
        ids, counts = joined(
            [some[0], more[0], *[np.array(o, np.int64) for o in others]],
            [some[1], more[1], np.array([len(o) for o in others], np.int64)],
            [here[letters], here[~letters], rest],
        )
        return ids.astype(np.uint32), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, in one array; and each text's number of ids."""
        words = common.Words(texts)
        used = self.pool.numbers(words.different)[words.codes]
        totals = np.bincount(words.text, self.pool.counts[used], words.counts.size).astype(np.int64) + 1
        out = np.full(int(totals.sum()), END_ID, np.int64)
        inside = np.ones(out.size, bool)
        inside[np.cumsum(totals) - 1] = False
        out[inside] = self.pool.gather(used)
        return out, totals


class Curve:
    """Places of documents on the curve; the projection is fixed by a seed."""

    def __init__(self, bits: int = BITS):
        made = np.random.default_rng(5)
        axes, _ = np.linalg.qr(made.normal(size=(HASHED, DIMENSIONS)))
        self.axes, self.bits = axes, bits

    def places(self, ids: np.ndarray, totals: np.ndarray) -> np.ndarray:
        bucket = (ids * 2_654_435_761 >> 7) % HASHED
        text = np.repeat(np.arange(totals.size), totals)
        vectors = np.bincount(text * HASHED + bucket, minlength=totals.size * HASHED)
        vectors = vectors.reshape(-1, HASHED).astype(float)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        side = 1 << self.bits
        cells = np.clip(((vectors @ self.axes) + 1) / 2 * side, 0, side - 1)
        return hilbert(cells.astype(np.int64), self.bits)


def tokenised(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, curve = common.of_worker(sent, lambda vocabulary: (WordCodec(vocabulary), Curve()))
        for batch in common.slices(batches, size=ENCODED):
            ids, totals = codec.encode(batch.column(1))
            packed = ids.astype("<u4")
            ends = np.cumsum(totals)
            texts = [packed[e - n : e].tobytes() for n, e in zip(totals.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(curve.places(ids, totals)), pa.array(texts, pa.binary())],
                names=TOKENISED.names,
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, TOKENISED)


def _tail(length: int) -> Iterator[int]:
    while length:
        yield (part := 1 << (length.bit_length() - 1))
        length -= part


def pack(batches: Iterator[pa.RecordBatch], partition: int, length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """Cut one sorted partition.  The open sequence's pieces wait until it is full, or the end."""
    sequence, used, open_ = partition << 40, 0, []  # open_: (doc_id, start, ids, doc_tokens)

    def closed(size: int) -> list[tuple]:
        """Rows of the first ``size`` waiting ids as one sequence; the rest stays open."""
        nonlocal sequence, used, open_
        rows, offset, rest = [], 0, []
        for doc, start, ids, total in open_:
            n = min(ids.size, size - offset)
            if n:
                rows.append((doc, start, n, zlib.crc32(ids[:n].tobytes()), total, sequence, offset))
                offset += n
            if n < ids.size:
                rest.append((doc, start + n, ids[n:], total))
        sequence, used, open_ = sequence + 1, used - size, rest
        return rows

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECES.names)

    for batch in common.slices(batches, column=2):
        rows = []
        for doc, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            ids, start = np.frombuffer(packed, "<u4"), 0
            while start < ids.size:
                n = min(ids.size - start, length - used)
                open_.append((doc, start, ids[start : start + n], ids.size))
                start, used = start + n, used + n
                if used == length:
                    rows += closed(length)
        if rows:
            yield batch_of(rows)
    if open_:
        yield batch_of([row for part in list(_tail(used)) for row in closed(part)])


def packed_documents(docs: DataFrame, vocabulary: bytes, length: int = LENGTH) -> DataFrame:
    """One row per piece of a document in a sequence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pack(batches, TaskContext.get().partitionId(), length)

    written = common.stored(tokenised(docs, vocabulary), "tokenised")
    placed = written.repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id", F.xxhash64("ids"))
    return placed.mapInArrow(run, PIECES)


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    vocabulary = read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return packed_documents(common.table(spark, sf, "documents"), vocabulary)
