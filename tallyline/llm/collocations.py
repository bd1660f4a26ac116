"""Phrases of two to four words that belong together, per language, from merged stripes.

A stripe is an associative counter of the words that follow a prefix.  Every chunk of documents makes
its stripes of the empty prefix (the words themselves), of one, two and three words; stripes of one
prefix are merged elementwise.  One structure then holds all that is asked for: an entry's total is
the number of times prefix and word stand together, so the total of a prefix is the entry of its last
word in the stripe of what stands before it, the extensions of a phrase are the entries of its own
stripe, and what subsumes a phrase is the largest entry among its one-word extensions to the right
and to the left (a phrase subsumed by a longer one is by one of these, as counts only fall).

Only entries that can still matter travel: a phrase of 30 occurrences consists of phrases with as many.
So there is a round for each length.  A merged stripe tells every chunk which of its entries reached 30,
as numbers local to the chunk, and the chunk keeps, in a written table, only the places where such
phrases follow each other; the next round counts there.  The text itself is read once, and no list of
words is broadcast or collected.  The stripes of all prefixes that begin with one word travel as one
row per chunk, the counters of the longer prefixes inside it.

Hot prefixes: the stripes that begin with a word met n times are dealt, by the words that follow, to
1 + n // ``PART`` parts that are merged apart; all chunks know n from the first round.  A part's entries
are at most one per chunk for each of its phrases.

Defined results: null texts are empty and have no words; a null lang counts as ``und``, together with
that name.  Repeated rows count as often as they stand there.  Ties rank by occurrences, then phrase
in the order of UTF-8 bytes.  An empty table gives an empty result; only ``lang`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.llm import common

#: Occurrences a phrase needs, words it may have, percent of its occurrences at which a longer phrase
#: subsumes it, scale of the score, and phrases listed per language.
LEAST, LONGEST, SUBSUMED, SCALE, LISTED = 30, 4, 80, 2_000_000, 2_000
#: Bytes of text of a chunk; occurrences of a prefix that make one part of its stripe.
CHUNK, PART = 8 << 20, 1_000_000
#: Most entries in one row of a stripe, so that batches of rows stay small.
ROW = 128
#: Rows of stripes sent on at once.
SENT = 2_048
#: Partial ranks are taken in so many groups of a language first.
GROUPS = 32
UNKNOWN = "und"

#: The bytes that separate pieces.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK, _SPACE = 0xFF, 0x20  # 0xFF is in no UTF-8 text
_FORM = bytes(
    _BREAK if c in _BREAKS else _SPACE if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)

COUNTED = "chunk long, lang string, n long, words array<string>, counts array<long>, codes binary, length long"
WORDS = "lang string, part int, chunk long, words array<string>, counts array<long>, codes array<int>"
MERGED_WORDS = "lang string, id long, word string, n long, chunk long, codes array<int>, ids array<long>, totals array<long>"
KEPT = "chunk long, ids array<long>, totals array<long>, codes binary, length long"
STRIPES = "a long, part int, chunk long, first long, rest array<long>, counts array<long>"
MERGED = "ids array<long>, n long, chunk long, codes array<long>"


def stored_codes(codes: np.ndarray) -> bytes:
    return pa.compress(codes.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def read_codes(data: bytes, length: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * length, "zstd", asbytes=True), "<i4").astype(np.int64)


def counted_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of texts, how often each occurs, and the words in order as numbers, with -1
    between pieces."""
    flat = np.frombuffer(b"\n".join(texts.cast(pa.binary()).to_pylist()).translate(_FORM), np.uint8)
    inside = (flat != _SPACE) & (flat != _BREAK)
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.r_[0, np.cumsum(ends - starts)]
    words = pa.Array.from_buffers(
        pa.large_binary(), starts.size, [None, pa.py_buffer(offsets), pa.py_buffer(flat[inside])]
    ).dictionary_encode()
    numbers = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    different = words.dictionary.to_pylist()
    piece = np.searchsorted(np.flatnonzero(flat == _BREAK), starts)
    first = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    return different, np.bincount(numbers, minlength=len(different)), np.insert(numbers, first, -1)


def _list(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values))


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """A row for each chunk and language, of about ``size`` bytes of text at most."""

    def rows(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        for lang in pc.unique(table.column(0)).to_pylist():
            texts = table.filter(pc.equal(table.column(0), lang)).column(1)
            words, counts, codes = counted_words(pa.concat_arrays(texts.chunks))
            if words:
                out = ([number], [lang], [int(counts.sum())], [[w.decode() for w in words]], [counts], [stored_codes(codes)], [codes.size])
                types = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.int64())
                names = "chunk lang n words counts codes length".split()
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=names)
                number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, bytes_ = TaskContext.get().partitionId() << 32, [], 0
        for batch in common.slices(batches):
            held.append(batch)
            bytes_ += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
            if bytes_ >= size:
                for row in rows(number, held):
                    yield row
                    number += 1
                held, bytes_ = [], 0
        if held:
            yield from rows(number, held)

    known = F.coalesce(docs["lang"].cast("string"), F.lit(UNKNOWN))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(known.alias("lang"), text.alias("text")).mapInArrow(run, COUNTED)


def word_stripes(found: DataFrame, part: int) -> DataFrame:
    """The stripes of the empty prefix, dealt by word."""
    sizes = found.groupBy("lang").agg(F.sum("n").alias("all"))
    parts = sizes.select("lang", (F.floor(F.col("all") / part) + 1).cast("int").alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, of, chunk = (batch.column(n)[i].as_py() for n in ("lang", "parts", "chunk"))
                words = batch.column("words")[i].values
                counts = batch.column("counts")[i].values.to_numpy(zero_copy_only=False)
                dealt = pc.cast(batch.column("dealt")[i].values, pa.int64()).to_numpy(zero_copy_only=False) % of
                order = np.argsort(dealt, kind="stable")
                sizes, keys = _row_sizes(dealt[order])
                n = sizes.size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * n, pa.string()),
                        pa.array(keys, pa.int32()),
                        pa.array([chunk] * n, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), words.take(pa.array(order))),
                        _list(counts[order], sizes),
                        _list(order.astype(np.int32), sizes),
                    ],
                    names="lang part chunk words counts codes".split(),
                )

    dealt = F.transform("words", lambda w: F.crc32(w.cast("binary"))).alias("dealt")
    return found.join(parts, "lang").select("lang", "parts", "chunk", "words", "counts", dealt).mapInArrow(run, WORDS)


def _row_sizes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the rows that hold runs of equal keys, none above ``ROW``, and their keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if keys.size else np.zeros(0, np.int64)
    runs = np.diff(np.r_[starts, keys.size])
    rows = -(-runs // ROW)
    owner = np.repeat(np.arange(runs.size), rows)
    nth = np.arange(owner.size) - np.repeat(np.cumsum(rows) - rows, rows)
    return np.minimum(runs[owner] - nth * ROW, ROW), keys[starts][owner]


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Batches sorted by their first columns, cut so that equal keys are together."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, bool)
        for column in batch.columns[:keys]:
            changed |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        borders = np.flatnonzero(changed) + 1
        last = int(borders[-1]) if borders.size else 0
        if waiting and any(c[0] != w[0] for c, w in zip(batch.columns[:keys], waiting[-1].columns[:keys])):
            yield pa.Table.from_batches(waiting)
            waiting = []
        if last:
            yield pa.Table.from_batches([*waiting, batch.slice(0, last)])
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield pa.Table.from_batches(waiting)


def merged_entries(
    group: np.ndarray, following: np.ndarray, counts: np.ndarray, least: int
) -> tuple[np.ndarray, ...]:
    """Stripes of several groups, merged elementwise: a row of each entry that reaches ``least``, its
    total, and for every entry given the number of its merged one, or -1.  ``following`` has a column
    for each word behind the first."""
    entry, first = group, None
    for column in following.T:
        names, word = np.unique(column, return_inverse=True)
        _, first, entry = np.unique(entry * names.size + word, return_index=True, return_inverse=True)
    totals = np.zeros(first.size, np.int64)
    np.add.at(totals, entry, counts)
    reached = totals >= least
    number = np.where(reached, np.cumsum(reached) - 1, -1)
    return first[reached], totals[reached], number[entry]


def merged_words(stripes: DataFrame, least: int) -> DataFrame:
    """Entries that reach ``least`` with an id of their own; and for each row of a chunk which of its
    words these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (TaskContext.get().partitionId() << 32) + 1  # 0 stands for no word in a prefix
        for table in _whole_groups(batches, 2):
            table = table.combine_chunks()
            lang = table.column("lang").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            part = table.column("part").to_numpy()
            sizes = pc.list_value_length(table.column("words")).to_numpy()
            group = np.repeat((lang.astype(np.int64) << 32) + part, sizes)
            group = np.unique(group, return_inverse=True)[1]
            texts = pc.list_flatten(table.column("words")).combine_chunks()
            word = texts.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            counts = pc.list_flatten(table.column("counts")).to_numpy()
            first, totals, number = merged_entries(group, word[:, None], counts, least)
            row = np.repeat(np.arange(table.num_rows), sizes)
            yield _words_batch(
                lang=table.column("lang").take(pa.array(row[first])).combine_chunks(), id=pa.array(given + np.arange(first.size)),
                word=texts.take(pa.array(first)), n=pa.array(totals),
            )
            met = np.flatnonzero(number >= 0)
            kept = np.bincount(row[met], minlength=table.num_rows)
            codes = pc.list_flatten(table.column("codes")).to_numpy()[met]
            yield _words_batch(
                chunk=table.column("chunk").combine_chunks(), codes=_list(codes, kept),
                ids=_list(given + number[met], kept), totals=_list(totals[number[met]], kept),
            )
            given += first.size

    dealt = stripes.repartition("lang", "part").sortWithinPartitions("lang", "part")
    return dealt.mapInArrow(run, MERGED_WORDS)


def _words_batch(**columns: pa.Array) -> pa.RecordBatch:
    types = {
        "lang": pa.string(), "id": pa.int64(), "word": pa.string(), "n": pa.int64(), "chunk": pa.int64(),
        "codes": pa.list_(pa.int32()), "ids": pa.list_(pa.int64()), "totals": pa.list_(pa.int64()),
    }
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [columns[k].cast(t) if k in columns else pa.nulls(size, t) for k, t in types.items()], names=list(types)
    )


def kept_words(found: DataFrame, merged: DataFrame) -> DataFrame:
    """The chunks with those words only that reached the least number, as numbers of their own."""
    back = merged.filter("chunk is not null").groupBy("chunk").agg(
        *(F.flatten(F.collect_list(c)).alias(f"to_{c}") for c in ("codes", "ids", "totals"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, ids, totals = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("to_codes", "to_ids", "to_totals"))
                codes = read_codes(batch.column("codes")[i].as_py(), batch.column("length")[i].as_py())
                number = np.full(max(int(codes.max()), int(at.max(initial=0))) + 2, -1)
                number[at] = np.arange(at.size)  # the last place is that of -1
                codes = number[codes]
                # Of places between words one is enough.
                codes = codes[np.r_[True, (codes[1:] >= 0) | (codes[:-1] >= 0)]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("chunk")[i : i + 1],
                        pa.array([ids], pa.list_(pa.int64())),
                        pa.array([totals], pa.list_(pa.int64())),
                        pa.array([stored_codes(codes)], pa.binary()),
                        pa.array([codes.size], pa.int64()),
                    ],
                    names="chunk ids totals codes length".split(),
                )

    return found.select("chunk", "codes", "length").join(back, "chunk").mapInArrow(run, KEPT)


class Chunk:
    """Words of a chunk as numbers of its own, with -1 between stretches, and its phrases of one size."""

    def __init__(self, batch: pa.RecordBatch, i: int, size: int, part: int):
        self.number = batch.column("chunk")[i].as_py()
        self.ids, self.totals = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "totals"))
        self.codes = read_codes(batch.column("codes")[i].as_py(), batch.column("length")[i].as_py())
        self.size = size
        inside = self.codes >= 0
        whole = inside[: max(inside.size - size + 1, 0)].copy()
        for k in range(1, size):
            whole &= inside[k : whole.size + k]
        self.begins = np.flatnonzero(whole)
        phrase = self.codes[self.begins]
        for k in range(1, size):
            key = phrase * max(self.ids.size, 1) + self.codes[self.begins + k]
            _, first, phrase = np.unique(key, return_index=True, return_inverse=True)
        self.phrase = phrase
        words = self.codes[self.begins[first][:, None] + np.arange(size)]
        # Phrases are numbered by first word, then part, so that a row of a stripe has numbers in a row.
        mixed = np.zeros(first.size, np.int64)
        for k in range(1, size):
            mixed = (mixed + self.ids[words[:, k]]) * 2_654_435_761 & 0x7FFFFFFFFFFF
        dealt = (mixed >> 11) % (self.totals[words[:, 0]] // part + 1)
        self.order = np.lexsort((dealt, words[:, 0]))
        self.words, self.dealt = words[self.order], dealt[self.order]

    def stripes(self) -> Iterator[pa.RecordBatch]:
        counts = np.bincount(self.phrase, minlength=self.order.size)[self.order]
        first = self.words[:, 0]
        change = (first[1:] != first[:-1]) | (self.dealt[1:] != self.dealt[:-1])
        sizes, _ = _row_sizes(np.cumsum(np.r_[0, change])[: first.size])
        starts = np.cumsum(sizes) - sizes
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array(self.ids[first[starts]]),
                pa.array(self.dealt[starts], pa.int32()),
                pa.array(np.full(sizes.size, self.number), pa.int64()),
                pa.array(starts),
                _list(self.ids[self.words[:, 1:]].ravel(), sizes * (self.size - 1)),
                _list(counts, sizes),
            ],
            names="a part chunk first rest counts".split(),
        )
        for at in range(0, batch.num_rows, SENT):
            yield batch.slice(at, SENT)

    def cut(self, reached: np.ndarray) -> pa.RecordBatch:
        """The stretches in which phrases that reached the least number follow each other."""
        good = np.zeros(self.order.size, bool)
        good[self.order[reached]] = True
        begins = self.begins[good[self.phrase]]
        last = np.diff(np.r_[begins, -9]) != 1
        alone = last & np.r_[True, last[:-1]][: last.size]
        begins, last = begins[~alone], last[~alone]
        # A stretch is the beginnings in a row and, behind the last one, the rest of its phrase and a break.
        sizes = np.where(last, self.size + 1, 1)
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.repeat(begins, sizes) + within
        codes = np.where(within < self.size, self.codes[np.minimum(place, self.codes.size - 1)], -1)
        used, new = np.unique(codes[codes >= 0], return_inverse=True)
        codes[codes >= 0] = new
        columns = (
            pa.array([self.number], pa.int64()),
            pa.array([self.ids[used]], pa.list_(pa.int64())),
            pa.array([self.totals[used]], pa.list_(pa.int64())),
            pa.array([stored_codes(codes)], pa.binary()),
            pa.array([codes.size], pa.int64()),
        )
        return pa.RecordBatch.from_arrays(list(columns), names="chunk ids totals codes length".split())


def stripes(kept: DataFrame, size: int, part: int) -> DataFrame:
    """The stripes of all prefixes of ``size - 1`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from Chunk(batch, i, size, part).stripes()

    return kept.mapInArrow(run, STRIPES)


def merged_stripes(given: DataFrame, size: int, least: int, answered: bool) -> DataFrame:
    """Phrases that reach ``least``; and, if asked for, which entries of each chunk's rows do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 2):
            a, part = (table.column(k).to_numpy() for k in ("a", "part"))
            change = (a[1:] != a[:-1]) | (part[1:] != part[:-1])
            sizes = pc.list_value_length(table.column("counts")).to_numpy()
            row = np.repeat(np.arange(table.num_rows), sizes)
            counts = pc.list_flatten(table.column("counts")).to_numpy()
            rest = pc.list_flatten(table.column("rest")).to_numpy().reshape(-1, size - 1)
            first, totals, number = merged_entries(np.cumsum(np.r_[0, change])[row], rest, counts, least)
            phrases = np.c_[a[row[first]], rest[first]]
            n = first.size
            yield _merged_batch(ids=_list(phrases.ravel(), np.full(n, size)), n=pa.array(totals))
            if answered:
                met = np.flatnonzero(number >= 0)
                has = np.bincount(row[met], minlength=table.num_rows)
                place = np.arange(row.size) - (np.cumsum(sizes) - sizes)[row] + table.column("first").to_numpy()[row]
                chunk = table.column("chunk").to_numpy()[has > 0]
                yield _merged_batch(chunk=pa.array(chunk), codes=_list(place[met], has[has > 0]))

    return given.repartition("a", "part").sortWithinPartitions("a", "part").mapInArrow(run, MERGED)


def _merged_batch(**columns: pa.Array) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    types = {"ids": longs, "n": pa.int64(), "chunk": pa.int64(), "codes": longs}
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [columns.get(k, pa.nulls(size, t)) for k, t in types.items()], names=list(types)
    )


def cut_chunks(kept: DataFrame, merged: DataFrame, size: int, part: int) -> DataFrame:
    """The chunks with those stretches only in which a phrase of one more word can lie."""
    back = merged.filter("chunk is not null").groupBy("chunk").agg(F.flatten(F.collect_list("codes")).alias("reached"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                reached = batch.column("reached")[i].values.to_numpy(zero_copy_only=False)
                yield Chunk(batch, i, size, part).cut(reached)

    return kept.join(back, "chunk").mapInArrow(run, KEPT)


def phrase_counts(docs: DataFrame, least: int = LEAST, size: int = CHUNK, part: int = PART) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, id, word, n), phrases (ids, n) of one to four words that occur ``least`` times, and
    (lang, n): all words of each language."""
    found = common.stored(chunks(docs, size), "words")
    words = common.stored(merged_words(word_stripes(found, part), least), "merged-words")
    totals = common.stored(found.groupBy("lang").agg(F.sum("n").alias("n")), "all-words")
    kept = common.stored(kept_words(found, words), "kept-words")
    common.discard(found)
    known = words.filter("id is not null").select("lang", "id", "word", "n")
    phrases = known.select(F.array("id").alias("ids"), "n")
    for length in range(2, LONGEST + 1):
        merged = merged_stripes(stripes(kept, length, part), length, least, answered=length < LONGEST)
        merged = common.stored(merged, f"phrases-{length}")
        phrases = phrases.unionByName(merged.filter("ids is not null").select("ids", "n"))
        before = kept
        if length < LONGEST:
            kept = common.stored(cut_chunks(kept, merged, length, part), f"kept-{length}")
        common.discard(before)
    return known, phrases, totals


def _exact(value: Column | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("decimal(19,0)")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = LISTED, size: int = CHUNK, part: int = PART
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language."""
    words, phrases, totals = phrase_counts(docs, least, size, part)
    phrases = common.stored(phrases, "phrases")
    candidates = phrases.filter(F.size("ids") > 1)
    inner = F.array(F.slice("ids", 1, F.size("ids") - 1), F.slice("ids", 2, F.size("ids") - 1))
    covered = (
        candidates.filter(F.size("ids") > 2)
        .select(F.explode(inner).alias("ids"), "n")
        .groupBy("ids")
        .agg(F.max("n").alias("longer"))
    )
    subsumed = _exact(F.col("longer")) * _exact(100) >= _exact(F.col("n")) * _exact(SUBSUMED)
    alone = candidates.join(covered, "ids", "left").filter(F.coalesce(~subsumed, F.lit(True))).select("ids", F.col("n").alias("a"))

    def sides(ids: Column) -> Column:
        def both(k: Column) -> Column:
            return F.array(
                F.struct(k.alias("k"), F.lit(True).alias("left"), F.slice(ids, F.lit(1), k).alias("side")),
                F.struct(k.alias("k"), F.lit(False).alias("left"), F.slice(ids, k + 1, F.size(ids)).alias("side")),
            )

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(ids) - 1), both))

    cut = alone.select("ids", "a", F.inline(sides(F.col("ids"))))
    counted = cut.join(phrases.select(F.col("ids").alias("side"), "n"), "side")
    scored = (
        counted.groupBy("ids", "a", "k")
        .agg(F.max(F.when(F.col("left"), F.col("n"))).alias("l"), F.max(F.when(~F.col("left"), F.col("n"))).alias("r"))
        .withColumn("score", F.expr(f"cast({SCALE} * cast(a AS decimal(19,0)) div (cast(l AS decimal(19,0)) + r) AS bigint)"))
        .groupBy("ids", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("ids", "a", "cut.l", "cut.r", "cut.score")
    )
    named = (
        scored.select("*", F.posexplode("ids").alias("place", "id"))
        .join(words.select("lang", "id", "word"), "id")
        .groupBy("ids", "a", "l", "r", "score", "lang")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "word"))).getField("word"), " ").alias("phrase"))
        .drop("ids")
    )
    return ranked(named, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The best phrases of each language: of groups of phrases first, so that no task sorts them all."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))
    few = rows.withColumn("group", group).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order)))
    few = few.filter(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return best.filter(F.col("rank") <= top).drop("group")


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(common.table(spark, sf, "documents"))


SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, doc_id, piece,
        list_filter(regexp_split_to_array(text, '[ \t]+'), lambda w: w <> '') AS words
    FROM (
        SELECT lang, doc_id, unnest(list) AS text, generate_subscripts(list, 1) AS piece
        FROM (
            SELECT lang, doc_id, regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]') AS list
            FROM documents
        )
    )
),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
    SELECT lang, size, gram, count(*) AS f
    FROM (
        SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: words[i:i + size - 1])) AS gram
        FROM pieces, (VALUES (1), (2), (3), (4)) AS s(size)
        WHERE len(words) >= size
    )
    GROUP BY lang, size, gram
    HAVING count(*) >= 30
),
covered AS (
    SELECT lang, inner_gram, max(f) AS f
    FROM (
        SELECT lang, f, unnest([gram[1:size - 1], gram[2:size]]) AS inner_gram FROM grams WHERE size > 2
    )
    GROUP BY lang, inner_gram
),
candidates AS (
    SELECT g.lang, g.size, g.gram, g.f AS a
    FROM grams g LEFT JOIN covered c ON c.lang = g.lang AND c.inner_gram = g.gram
    WHERE g.size > 1 AND (c.f IS NULL OR 100::HUGEINT * c.f < 80::HUGEINT * g.f)
),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
scored AS (
    SELECT c.lang, c.gram, c.a, c.k, p.f AS l, s.f AS r,
        (2000000::HUGEINT * c.a // (p.f::HUGEINT + s.f))::BIGINT AS score
    FROM cuts c
    JOIN grams p ON p.lang = c.lang AND p.gram = c.gram[1:c.k]
    JOIN grams s ON s.lang = c.lang AND s.gram = c.gram[c.k + 1:c.size]
),
lowest AS (
    SELECT lang, array_to_string(gram, ' ') AS phrase, a, l, r, score
    FROM scored
    QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
) JOIN totals USING (lang)
WHERE rank <= 2000
"""
