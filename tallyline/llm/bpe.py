"""Byte-level BPE encoding and decoding with numpy merge rounds over many words at once.

The symbols of all new words of a slice of documents lie in one flat array.  A round looks up every
neighbouring pair by binary search in the sorted pair keys, takes the lowest rank of each word and
merges all its occurrences; words without a known pair leave the array.  Words seen before come from
a bounded cache of the worker, which changes no result.

Defined results: a null text is an empty one with no ids (the digests are those of the empty
string).  Special tokens written out in a text become their ids, as in the library's default.
Repeated rows give equal rows, an empty table an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyline.llm import common

#: Fixed value: the public pre-tokenisation pattern of byte-level BPE vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts in which a space stands beside other white space, or first or last, are split as a whole.
_LOOSE = r"(^|[\s\x0B\x1C-\x1F\x{85}\p{Z}]) | ([\s\x0B\x1C-\x1F\x{85}\p{Z}]|$)"
_NONE = np.iinfo(np.int64).max
#: Pair keys are spread over this many bits of places, by a multiplication.
_PLACES, _MIX = 18, np.uint64(0x9E3779B97F4A7C15)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    named = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    return [named[b] for b in range(256)]


class Merges:
    """Merge rules as sorted arrays, and the batched merge rounds.

    ``suffix`` marks the last symbol of a word in vocabularies that have word ends.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        alphabet = byte_alphabet()
        self.of_byte = np.array([vocab[c] for c in alphabet], np.int64)
        self.of_last = np.array([vocab[c + suffix] for c in alphabet], np.int64)
        back = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.base = max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        # Where a pair key most likely stands; keys that share a place with a smaller one are searched.
        place = self.place(self.keys)
        self.first = np.zeros(1 << _PLACES, np.int32)
        self.first[place[::-1]] = np.arange(self.keys.size, dtype=np.int32)[::-1]
        self.shared = np.zeros(1 << _PLACES, bool)
        self.shared[place[self.first[place] != np.arange(self.keys.size)]] = True

    @staticmethod
    def place(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _MIX >> np.uint64(64 - _PLACES)).view(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of neighbouring symbols, and what they merge to."""
        keys = left * self.base + right
        place = self.place(keys)
        at = self.first[place]
        found = self.keys[at] == keys
        rest = np.flatnonzero(self.shared[place] & ~found)
        if rest.size:
            at[rest] = np.minimum(np.searchsorted(self.keys, keys[rest]), self.keys.size - 1)
            found[rest] = self.keys[at[rest]] == keys[rest]
        return np.where(found, self.ranks[at], _NONE), self.merged[at]

    def encode(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words given as bytes one after the other, and how many ids each word has."""
        number = lengths.size
        symbols, last = self.of_byte[flat], np.cumsum(lengths) - 1
        symbols[last] = self.of_last[flat[last]]
        word = np.repeat(np.arange(number), lengths)
        ranks, merged = np.full(symbols.size, _NONE), np.zeros(symbols.size, np.int64)
        stale = np.flatnonzero(word[:-1] == word[1:])
        done_symbols, done_word = [], []
        while symbols.size:
            ranks[stale], merged[stale] = self.pairs(symbols[stale], symbols[stale + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(ranks, starts)
            lowest = np.repeat(lowest, np.diff(np.r_[starts, symbols.size]))
            gone = lowest == _NONE
            done_symbols.append(symbols[gone])
            done_word.append(word[gone])
            here = np.flatnonzero((ranks == lowest) & ~gone)
            # Of overlapping pairs (a a a) every second one counts, from the left.
            run = np.flatnonzero(np.r_[True, np.diff(here) > 1]) if here.size else here
            within = np.arange(here.size) - np.repeat(run, np.diff(np.r_[run, here.size]))
            here = here[within % 2 == 0]
            symbols[here] = merged[here]
            gone[here + 1] = True
            changed = np.zeros(symbols.size, bool)
            changed[here] = True
            kept = ~gone
            symbols, word, ranks, merged, changed = (x[kept] for x in (symbols, word, ranks, merged, changed))
            changed[:-1] |= changed[1:]
            ranks[changed] = _NONE
            stale = np.flatnonzero(changed[:-1] & (word[:-1] == word[1:]))
        if not done_word:
            return np.zeros(0, np.int64), np.zeros(number, np.int64)
        word, symbols = np.concatenate(done_word), np.concatenate(done_symbols)
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=number)

    def encode_found(self, found: list[str], mark: str, end: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces found in texts that ``end`` separates, and how many each text has.  Pieces
        must not hold ``mark``."""
        flat = np.frombuffer(mark.join([*found, end]).encode(), np.uint8)
        cuts = np.flatnonzero(flat == ord(mark))
        lengths = np.diff(np.r_[-1, cuts, flat.size]) - 1
        ends = (lengths == 1) & (flat[np.r_[0, cuts + 1]] == ord(end))
        text = np.cumsum(ends) - ends
        keep = flat != ord(mark)
        keep[np.r_[0, cuts + 1][ends]] = False
        ids, counts = self.encode(flat[keep], lengths[~ends])
        return ids, np.bincount(text[~ends], counts, int(ends.sum())).astype(np.int64)


def joined(parts: list[np.ndarray], counts: list[np.ndarray], owners: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values learned in several ways, in the order of their owners."""
    owner, count, values = np.concatenate(owners), np.concatenate(counts), np.concatenate(parts)
    order = np.argsort(owner, kind="stable")
    return common.gathered(values, (np.cumsum(count) - count)[order], count[order]), count[order]


class Codec:
    """Encodes texts to ids and decodes ids to bytes.

    A space between two characters that are no white space always begins a piece, so that texts may
    be cut there and each cut, a word with its space, be encoded once.
    """

    def __init__(self, spec: dict, cached: int = common.CACHE_WORDS):
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"])
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        named = sorted((re.escape(t.decode()) for t in self.special), key=len, reverse=True)
        self.split = regex.compile("|".join(f"({n})" for n in named)) if named else None
        self.loose = "|".join([_LOOSE, *named])
        self.find = regex.compile(PIECES).findall
        self.pool = common.Pool(self.learned, cached)
        texts = self.merges.bytes_of | {i: t for t, i in self.special.items()}
        size = max(texts) + 1
        self.texts = _Runs([texts.get(i, b"") for i in range(size)])
        self.names = _Runs([b"%d," % i for i in range(size)])

    def pieces(self, text: str) -> list[bytes]:
        """Keys of the pieces of a whole text: ``\xff`` and the piece, or ``\xfe`` and a special token."""
        out, at = [], 0
        for found in self.split.finditer(text) if self.split else ():
            out += [b"\xff" + p.encode() for p in self.find(text[at : found.start()])]
            out.append(b"\xfe" + found[0].encode())
            at = found.end()
        return out + [b"\xff" + p.encode() for p in self.find(text[at:])]

    def learn(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of keys: pieces and special tokens as above, other keys follow a space."""
        plain, others, texts = [], [], []
        for i, key in enumerate(keys):
            text = key.decode() if key[:1] < b"\xfe" and b"\0" not in key else ""
            if text.split() == [text]:
                plain.append(i)
                texts.append(text)
            else:
                others.append(i)
        text = "\n".join([" " + t for t in texts])
        ids, counts = self.merges.encode_found(self.find(text), "\0", "\n") if plain else _nothing()
        fixed = [i for i in others if keys[i][:1] == b"\xfe"]
        words, owner = [], []
        for i in others:
            if keys[i][:1] != b"\xfe":
                key = keys[i]
                found = self.find(key[1:].decode() if key[:1] == b"\xff" else " " + key.decode())
                words += [p.encode() for p in found]
                owner += [i] * len(found)
        more, of_words = self.merges.encode(
            np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
        )
        rest = np.setdiff1d(others, fixed).astype(np.int64)
        totals = np.bincount(np.array(owner, np.int64), of_words, len(keys)).astype(np.int64)
        return joined(
            [ids, more, np.array([self.special[keys[i][1:]] for i in fixed], np.int64)],
            [counts, totals[rest], np.ones(len(fixed), np.int64)],
            [np.array(plain, np.int64), rest, np.array(fixed, np.int64)],
        )

    def learned(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.learn(keys)
        return ids.astype(np.uint32), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        texts = pc.fill_null(texts, "")
        loose = pc.match_substring_regex(texts, self.loose).to_numpy(zero_copy_only=False)
        words = common.Words(pc.if_else(pa.array(~loose), texts, ""), space_only=True)
        first = np.cumsum(words.counts) - words.counts
        plain, odd = np.flatnonzero(~loose), np.flatnonzero(loose)
        whole = [self.pieces(texts[int(i)].as_py()) for i in odd]
        heads = [b"\xff" + words.different[c] for c in words.codes[first[plain]]]
        asked = words.different + heads + [k for of in whole for k in of]
        numbers = self.pool.numbers(asked)
        number = numbers[words.codes]
        n = len(words.different)
        number[first[plain]] = numbers[n : n + len(heads)]
        # The pieces of texts split as a whole stand in for the one empty word they have above.
        counts = words.counts.copy()
        counts[odd] = [len(of) for of in whole]
        out = np.empty(int(counts.sum()), np.int64)
        is_odd = np.repeat(loose, counts)
        out[is_odd] = numbers[n + len(heads) :]
        out[~is_odd] = number[np.repeat(~loose, words.counts)]
        text = np.repeat(np.arange(counts.size), counts)
        totals = np.bincount(text, self.pool.counts[out], counts.size).astype(np.int64)
        return self.pool.gather(out), totals

    def decode(self, ids: np.ndarray) -> bytes:
        return self.texts.join(ids)


def _nothing() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


class _Runs:
    """Byte strings by number, joined by gathering from one flat array."""

    def __init__(self, strings: list[bytes]):
        self.counts = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.values = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, numbers: np.ndarray) -> bytes:
        return common.gathered(self.values, self.starts[numbers], self.counts[numbers]).astype(np.uint8).tobytes()


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def read_vocabulary(path: str) -> bytes:
    """A tokenizer file: of fixed size, so it can be sent to all executors."""
    with open(path, "rb") as file:
        return file.read()


def encoded_documents(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """Number of ids and the digests of ids and of the decoded text, per document."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = common.of_worker(sent, lambda vocabulary: Codec(json.loads(vocabulary)))
        for batch in common.slices(batches):
            ids, totals = codec.encode(batch.column(1))
            ends = np.cumsum(totals)
            names, texts = [], []
            for start, end in zip((ends - totals).tolist(), ends.tolist()):
                own = ids[start:end]
                names.append(_digest(codec.names.join(own)[:-1]))
                texts.append(_digest(codec.decode(own).decode("utf-8", "replace").encode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals), pa.array(names), pa.array(texts)], names=SCHEMA.names
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def op3_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    vocabulary = read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return encoded_documents(common.table(spark, sf, "documents"), vocabulary)
