"""Token counts of whole texts, with overlapping chunks spliced in huge documents.

A document of at most ``CHUNK`` characters is encoded at once.  A longer one is encoded in chunks that
overlap, with the character offsets of their tokens, and the chunks are spliced at a token that both
have at the same place: the tokens up to it come from the left chunk, those after it from the right.

Why that is exact: merging always takes the best pair there is, the leftmost of equal ones.  A row of
tokens is what a text encodes to if and only if every two neighbours, taken alone, encode to
themselves; for the first merge across a border would need two symbols that the two tokens alone would
merge at the same moment.  In the spliced row every two neighbours stand side by side in one of the
two encodings, since the shared token is in both.  The same argument covers the space that the library
adds in front of a chunk: its token is never used for a splice.

If the overlap shows no shared token, it is doubled; if it would reach back to the beginning of the
left chunk, the text is encoded anew from its start to the end of the right chunk, with chunks of
twice the size from there on.  No text is counted by guess.

Defined results: a null text is an empty one with no bytes and no tokens.  Special tokens written out
in a text are treated as the library does by default.  Repeated rows give equal rows, an empty table
an empty result; only ``doc_id`` and ``text`` are read, and a null doc_id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm import common
from tallyline.llm.bpe import read_vocabulary

#: Characters of a chunk, and of the first overlap tried.
CHUNK, OVERLAP = 32_768, 128
#: A context of so many tokens is exceeded by longer documents.
LIMIT = 4_096

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


class Pieces:
    """The tokens of a vocabulary of pieces, with the characters that each of them covers."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.model.get_piece_size())
        self.is_byte = np.array([self.model.is_byte(i) for i in ids])
        # Of the bytes of one character the first counts for it, the following ones for nothing.
        self.chars = np.array(
            [int(p[3:5], 16) & 0xC0 != 0x80 if b else len(p) for p, b in zip(map(self.model.id_to_piece, ids), self.is_byte)],
            np.int64,
        )

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def spans(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the tokens of ``text[start:end]`` begin and end, and which can be shared."""
        ids = np.array(self.model.encode(text[start:end]), np.int64)
        ends = start - 1 + np.cumsum(self.chars[ids])  # the added space stands before the start
        if ids.size and ends[-1] != end:
            raise ValueError("tokens do not cover the text")
        begins = ends - self.chars[ids]
        return begins, ends, ~self.is_byte[ids] & (begins >= start)


def shared(left: tuple, right: tuple) -> tuple[int, int] | None:
    """Numbers, in two encodings, of the first token that both have at one place."""
    at, to = np.flatnonzero(left[2]), np.flatnonzero(right[2])
    _, i, j = np.intersect1d(left[0][at], right[0][to], assume_unique=True, return_indices=True)
    same = np.flatnonzero(left[1][at[i]] == right[1][to[j]])
    return (int(at[i[same[0]]]), int(to[j[same[0]]])) if same.size else None


def spliced_count(pieces: Pieces, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of the whole text."""
    start, end = 0, min(chunk, len(text))
    left = pieces.spans(text, start, end)
    counted, first = 0, 0  # tokens before the left chunk's ``first`` one
    while end < len(text):
        back = end - overlap
        to = min(max(back, 0) + chunk, len(text))
        if back <= start or to <= end:
            # The overlap cannot grow inside the left chunk: widen to everything before.
            chunk *= 2
            start, end, counted, first = 0, min(end + chunk, len(text)), 0, 0
            left = pieces.spans(text, start, end)
            continue
        right = pieces.spans(text, back, to)
        met = shared(tuple(x[first:] for x in left), right)
        if met is None:
            overlap *= 2
            continue
        counted += met[0] + 1
        start, end, left, first = back, to, right, met[1] + 1
    return counted + left[0].size - first


def token_counts(docs: DataFrame, model: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = common.of_worker(sent, Pieces)
        for batch in common.slices(batches):
            texts = pc.fill_null(batch.column(1), "")
            sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            totals = np.zeros(len(texts), np.int64)
            short = np.flatnonzero(sizes <= chunk)
            totals[short] = [len(ids) for ids in pieces.encode(texts.take(pa.array(short)).to_pylist())]
            for i in np.flatnonzero(sizes > chunk):
                totals[i] = spliced_count(pieces, texts[int(i)].as_py(), chunk, overlap)
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(totals)], names=SCHEMA.names)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def op12_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    model = read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    found = token_counts(common.table(spark, sf, "documents"), model)
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
