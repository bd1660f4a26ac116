"""Alignment of the tokens of two vocabularies: a byte-level one (A) and one of pieces (B).

The ends of A's and of B's tokens are keys of two dictionaries, end to index.  The keys that both hold,
sorted, slice both id lists into groups; inside a slice every token that begins starts a new link, so
that all pairs whose bytes overlap are linked, each once.

Both vocabularies end a token where a space follows a character that is no white space.  Texts are cut
there, and each different cut, a word with its space, is encoded and aligned once by a worker that
remembers it; cuts without such a place, however long, are handled the same way.

How many documents of the corpus hold an id pair is counted without sending pairs of single
documents around: a chunk of documents (about ``CHUNK`` bytes of text) is one row of a written table,
with its different pairs and how many of its documents hold each.  Only these are shuffled, by pair.
What a chunk needs of the totals comes back to it as one row, bounded by the chunk, and is added up
per document from the links that the chunk's row holds in compressed form.  A pair in every document
so is one row per chunk, and nothing is broadcast but the two vocabularies.

Defined results: null and empty texts, and texts whose joined token bytes differ from the space and
the text (the piece vocabulary writes U+2581 for a space), have no tokens: zeros and an empty digest.
Special tokens written out in a text are plain text.  Repeated rows give equal rows and count as
documents of their own; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm import common
from tallyline.llm.bpe import Codec, _Runs, read_vocabulary
from tallyline.llm.counts import Pieces

#: Bytes of text whose documents share one row of the chunk table.
CHUNK = 16 << 20
#: Numbers that stand before the links of a remembered cut: tokens of A, tokens of B, groups, unequal.
_HEAD = 4

_LONGS = T.ArrayType(T.LongType())
CHUNKS = T.StructType(
    [
        T.StructField("chunk", T.LongType()),
        *(T.StructField(name, _LONGS) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "entries")),
        T.StructField("groups_sha256", T.ArrayType(T.StringType())),
        T.StructField("links", T.BinaryType()),
        T.StructField("pairs", _LONGS),
        T.StructField("docs", _LONGS),
    ]
)
ALIGNED = T.StructType(
    [
        *(T.StructField(n, T.LongType()) for n in "doc_id n_a n_b n_groups n_links n_best count_sum".split()),
        T.StructField("groups_sha256", T.StringType()),
    ]
)


def cuts(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Each text behind a space, cut before spaces that follow a character that is no white space;
    and how many parts each text has."""
    joined = pc.binary_join_element_wise("", texts, " ").cast(pa.binary())
    bounds = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
    flat = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    # Printable ASCII, and of the two-byte characters those from U+00C0 on, hold no white space.
    solid = (flat > 0x20) & (flat < 0x7F)
    solid[1:] |= (flat[1:] >= 0x80) & (flat[:-1] >= 0xC3) & (flat[:-1] <= 0xDF)
    begins = np.zeros(flat.size, bool)
    begins[1:] = (flat[1:] == 0x20) & solid[:-1]
    begins[bounds[:-1]] = True
    starts = np.flatnonzero(begins)
    offsets = np.r_[starts, flat.size].astype(np.int32)
    parts = pa.Array.from_buffers(
        pa.binary(), starts.size, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]
    )
    return parts.dictionary_encode(), np.diff(np.searchsorted(starts, bounds))


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place where tokens of both lists end, how many tokens of each end up to there."""
    index_a = dict(zip(ends_a.tolist(), range(1, ends_a.size + 1)))
    index_b = dict(zip(ends_b.tolist(), range(1, ends_b.size + 1)))
    both = sorted(index_a.keys() & index_b.keys())
    return np.array([index_a[e] for e in both], np.int64), np.array([index_b[e] for e in both], np.int64)


def linked(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of tokens whose bytes overlap, and the byte at which each overlap begins."""
    begins = np.zeros((2, int(ends_a[-1]) if ends_a.size else 0), bool)
    for side, ends in zip(begins, (ends_a, ends_b)):
        side[np.r_[0, ends[:-1]][: ends.size]] = True
    at = np.flatnonzero(begins.any(axis=0))
    return np.cumsum(begins[0, at]) - 1, np.cumsum(begins[1, at]) - 1, at


class Aligner:
    """Tokens and links of texts in two vocabularies."""

    def __init__(self, vocabulary: bytes, model: bytes, cached: int = common.CACHE_WORDS // 2):
        self.codec, self.pieces = Codec(json.loads(vocabulary)), Pieces(model)
        number = self.pieces.model.get_piece_size()
        names = [self.pieces.model.id_to_piece(i) for i in range(number)]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("pieces of the vocabulary cross word borders")
        self.space = names.index("▁")
        self.bytes_a = self.codec.texts
        self.bytes_b = _Runs(
            [bytes([int(n[3:5], 16)]) if b else n.replace("▁", " ").encode() for n, b in zip(names, self.pieces.is_byte)]
        )
        # Decimal ids with what follows them: a comma inside a side, a bar or a semicolon at its end.
        self.size_a, self.size_b = self.bytes_a.counts.size, number
        self.names = _Runs(
            [b"%d%c" % (i, c) for i in range(self.size_a) for c in b",|"] + [b"%d%c" % (i, c) for i in range(number) for c in b",;"]
        )
        self.pool = common.Pool(self.learn, cached)

    def learn(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Per part the counts of its head and its id pairs; and its groups as text."""
        sizes = np.array([len(p) for p in parts], np.int64)
        flat = np.frombuffer(b"".join(parts), np.uint8)
        ids_a, n_a = self.codec.learn([p[1:] for p in parts])
        found = self.pieces.encode([p[1:].decode() for p in parts])
        found = [[self.space] if p == b" " else f for p, f in zip(parts, found)]
        n_b = np.array([len(f) for f in found], np.int64)
        ids_b = np.array([i for f in found for i in f], np.int64)
        good = self._equal(ids_a, n_a, self.bytes_a, flat, sizes) & self._equal(ids_b, n_b, self.bytes_b, flat, sizes)
        ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        n_a, n_b, sizes = n_a * good, n_b * good, sizes * good
        ends_a, ends_b = np.cumsum(self.bytes_a.counts[ids_a]), np.cumsum(self.bytes_b.counts[ids_b])
        stops = np.cumsum(sizes)
        to_a, to_b = groups(ends_a, ends_b)
        n_groups = np.diff(np.searchsorted(ends_a[to_a - 1], np.r_[0, stops], side="right"))
        at_a, at_b, at = linked(ends_a, ends_b)
        n_links = np.diff(np.searchsorted(at, np.r_[0, stops]))
        head = np.stack([n_a, n_b, n_groups, (~good).astype(np.int64)], 1)
        counts = n_links + _HEAD
        values = np.empty(int(counts.sum()), np.int64)
        heads = (np.cumsum(counts) - counts)[:, None] + np.arange(_HEAD)
        values[heads] = head
        rest = np.ones(values.size, bool)
        rest[heads] = False
        values[rest] = ids_a[at_a] * self.size_b + ids_b[at_b]
        return values, counts, self._texts(ids_a, ids_b, to_a, to_b, n_a + n_b)

    def _equal(self, ids, counts, texts: _Runs, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the token bytes of each part, joined, are the part."""
        owner = np.repeat(np.arange(sizes.size), counts)
        same = np.bincount(owner, texts.counts[ids], sizes.size).astype(np.int64) == sizes
        joined = np.frombuffer(texts.join(ids[same[owner]]), np.uint8)
        differ = joined != flat[np.repeat(same, sizes)]
        same[np.repeat(np.arange(sizes.size), sizes * same)[differ]] = False
        return same

    def _texts(self, ids_a, ids_b, to_a, to_b, tokens: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2;`` of every part."""
        last_a, last_b = np.zeros(ids_a.size, np.int64), np.zeros(ids_b.size, np.int64)
        last_a[to_a - 1] = last_b[to_b - 1] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        named = np.empty(ids_a.size + ids_b.size, np.int64)
        # A group's tokens of A stand behind all earlier tokens of B, those of B behind its own of A.
        named[np.arange(ids_a.size) + np.r_[0, to_b][group_a]] = 2 * ids_a + last_a
        named[np.arange(ids_b.size) + to_a[group_b]] = 2 * (self.size_a + ids_b) + last_b
        text = self.names.join(named)
        ends = np.r_[0, np.cumsum(self.names.counts[named])][np.cumsum(tokens)]
        return [text[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def align(self, texts: pa.Array) -> Documents:
        texts = pc.fill_null(texts, "")
        parts, counts = cuts(texts)
        numbers = self.pool.numbers(parts.dictionary.to_pylist())
        heads = self.pool.values[self.pool.runs.starts[numbers][:, None] + np.arange(_HEAD)]
        codes = parts.indices.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(texts)), counts)
        totals = np.stack([np.bincount(owner, heads[codes, i], len(texts)) for i in range(_HEAD)], 1).astype(np.int64)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) | (totals[:, 3] > 0)
        totals[empty] = 0
        used = numbers[codes][~empty[owner]]
        owner = owner[~empty[owner]]
        n_links = self.pool.counts[used] - _HEAD
        pairs = common.gathered(self.pool.values, self.pool.runs.starts[used] + _HEAD, n_links)
        whole = self.size_a * self.size_b
        keys, times = np.unique(np.repeat(owner, n_links) * whole + pairs, return_counts=True)
        digests, notes = [], self.pool.notes
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        listed = used.tolist()
        for a, b in zip(bounds, bounds[1:]):
            text = b"".join([notes[i] for i in listed[a:b]])[:-1]
            digests.append(hashlib.sha256(text).hexdigest() if text else "")
        links = np.bincount(owner, n_links, len(texts)).astype(np.int64)
        entries = np.bincount(keys // whole, minlength=len(texts))
        return Documents(np.c_[totals[:, :3], links, entries], digests, keys % whole, times)


class Documents:
    """Of documents: the five counts of each, digests, and per document its different pairs, ascending,
    with their numbers of links."""

    def __init__(self, sizes: np.ndarray, digests: list[str], pairs: np.ndarray, times: np.ndarray):
        self.sizes, self.digests, self.pairs, self.times = sizes, digests, pairs, times


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers with their first bytes together, then the second, and so on."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def chunk_row(number: int, ids: list[pa.Array], found: list[Documents]) -> pa.RecordBatch:
    sizes = np.concatenate([d.sizes for d in found])
    pairs, place, docs = np.unique(
        np.concatenate([d.pairs for d in found]), return_inverse=True, return_counts=True
    )
    times = np.concatenate([d.times for d in found])
    links = pa.compress(packed(np.concatenate([place, times])), codec="zstd", asbytes=True)
    columns = [
        [number],
        [pa.concat_arrays(ids)],
        *([pa.array(sizes[:, i])] for i in range(5)),
        [[d for f in found for d in f.digests]],
        [links],
        [pa.array(pairs)],
        [pa.array(docs)],
    ]
    types = [pa.int64(), *[pa.list_(pa.int64())] * 6, pa.list_(pa.string()), pa.binary(), *[pa.list_(pa.int64())] * 2]
    arrays = [
        pa.ListArray.from_arrays(pa.array([0, len(c[0])], pa.int32()), c[0]) if isinstance(c[0], pa.Array) else pa.array(c, t)
        for c, t in zip(columns, types)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=CHUNKS.names)


def chunks(docs: DataFrame, vocabulary: bytes, model: bytes, size: int = CHUNK) -> DataFrame:
    """Rows of about ``size`` bytes of text each, one document at least."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = common.of_worker(sent, lambda given: Aligner(*given))
        number, held, ids, found = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in common.slices(batches):
            ids.append(batch.column(0))
            found.append(aligner.align(batch.column(1)))
            held += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
            if held >= size:
                yield chunk_row(number, ids, found)
                number, held, ids, found = number + 1, 0, [], []
        if found:
            yield chunk_row(number, ids, found)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, CHUNKS)


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): documents with the pair linked, and whether that is the most of its A id."""
    held = found.select(F.inline(F.arrays_zip("pairs", "docs")))
    totals = common.stored(held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n")), "pairs")
    a = F.expr(f"pair div {size_b}")
    most = totals.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return totals.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            entries = row["entries"].values.to_numpy(zero_copy_only=False)
            total = int(entries.sum())
            place, times = np.split(unpacked(pa.decompress(row["links"].as_py(), 8 * total, "zstd", asbytes=True)), 2)
            if total:
                back = row["back"].values
                pair, n, best = (back.field(k).to_numpy(zero_copy_only=False) for k in ("pair", "n", "best"))
                order = np.argsort(pair)
                n, best = n[order][place] * times, best[order][place] * times
            else:
                n = best = np.zeros(0, np.int64)
            ends = np.cumsum(entries)
            sums = [np.diff(np.r_[0, np.cumsum(x)][np.r_[0, ends]]) for x in (best, n)]
            plain = [row[c].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays(
                [*plain, *(pa.array(s, pa.int64()) for s in sums), row["groups_sha256"].values], names=ALIGNED.names
            )


def aligned_documents(docs: DataFrame, vocabulary: bytes, model: bytes, size: int = CHUNK) -> DataFrame:
    """Per document its tokens, groups and links, and how common its id pairs are in the corpus."""
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    found = common.stored(chunks(docs, vocabulary, model, size), "aligned")
    wanted = found.select("chunk", F.explode("pairs").alias("pair"))
    counted = F.collect_list(F.struct("pair", "n", "best")).alias("back")
    back = wanted.join(pair_counts(found, size_b), "pair").groupBy("chunk").agg(counted)
    return found.drop("pairs", "docs").join(back, "chunk", "left").mapInArrow(_per_document, ALIGNED)


def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    vocabulary = read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    model = read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return aligned_documents(common.table(spark, sf, "documents"), vocabulary, model)
