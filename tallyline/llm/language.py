"""Language identification with a small bidirectional recurrent network over bytes.

Two gated recurrent units read the bytes of a word, one from each side, and a softmax over both
states labels every position with a language.  A document's probabilities are the mean over all its
positions.  The network reads words (runs without ASCII white space) in lower-case ASCII and without
digits and ASCII punctuation; its states begin anew with every word and after ``STRETCH`` bytes, so a
word that a worker has met needs no second reading.

The network is trained by backpropagation through time on the words of at most
``1.2 * TRAIN_DOCS`` documents of each language, chosen by a hash of the doc_id; the bound is for
fitting only.  Predictions read whole texts.

Defined results: null texts and texts without a letter are ``und`` with score 0.  Ties go to the
language first in order.  Without any labelled document all texts are ``und``.  Repeated rows get
equal results, an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import common

TRAIN_DOCS = 300
#: Different words of a language kept for training, the most frequent ones first by their hash order.
TRAIN_WORDS = 8_000
HIDDEN = 8
STRETCH = 24
#: Bytes of text read at once: what is made of each word takes many times its bytes for a moment.
READ = 1 << 20
BATCH, EPOCHS, RATE = 256, 2, 0.02
UNKNOWN = "und"
_LETTER = r"\p{L}"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_DROPPED = bytes(c for c in range(128) if not chr(c).isalpha())


def read_form(word: bytes) -> bytes:
    return word.translate(_LOWER, _DROPPED)


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words, one row each, and their lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), max(int(lengths.max(initial=0)), 1)), np.uint8)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out, lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """``p`` holds, per direction, byte rows ``x`` (256, 3H), state weights ``h`` (H, 3H); gates are
    reset, update and candidate; and the output ``o`` (2H, L) with its bias ``c``."""

    languages: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 3) -> Network:
        made, p = np.random.default_rng(seed), {}
        for side in "fb":
            p["x" + side] = made.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            p["h" + side] = made.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        p["o"] = made.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        p["c"] = np.zeros(len(languages), np.float32)
        return cls(languages, p)

    def states(self, data: np.ndarray, alive: np.ndarray, side: str, kept: list | None = None) -> np.ndarray:
        """States (T, N, H) after each byte; a state stays where a word has no byte."""
        x, h = self.p["x" + side], self.p["h" + side]
        width, steps = h.shape[0], data.shape[1]
        state = np.zeros((data.shape[0], width), np.float32)
        out = np.zeros((steps, data.shape[0], width), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            given, from_ = x[data[:, t]], state @ h
            gates = _sigmoid(given[:, : 2 * width] + from_[:, : 2 * width])
            reset, update = gates[:, :width], gates[:, width:]
            candidate = np.tanh(given[:, 2 * width :] + reset * from_[:, 2 * width :])
            new = state + alive[:, t : t + 1] * update * (candidate - state)
            if kept is not None:
                kept.append((t, state, from_[:, 2 * width :], reset, update, candidate))
            out[t] = state = new
        return out

    def positions(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (T, N, L) of every position, and which positions are bytes (N, T)."""
        alive = (np.arange(data.shape[1]) < lengths[:, None]).astype(np.float32)
        both = np.concatenate([self.states(data, alive, s) for s in "fb"], axis=2)
        logits = both @ self.p["o"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits, alive

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """Sums over the positions of each word (N, L)."""
        parts, owner = [], []
        for i, w in enumerate(words):
            for at in range(0, len(w), STRETCH):
                parts.append(w[at : at + STRETCH])
                owner.append(i)
        out = np.zeros((len(words), len(self.languages)))
        order = np.argsort([len(p) for p in parts], kind="stable")
        for at in range(0, len(parts), 2_048):
            some = order[at : at + 2_048]
            found, alive = self.positions(*padded([parts[i] for i in some]))
            np.add.at(out, np.array(owner)[some], np.einsum("tnl,nt->nl", found, alive))
        return out

    def gradients(self, data: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions, by backpropagation through time."""
        alive = (np.arange(data.shape[1]) < lengths[:, None]).astype(np.float32)
        kept = {s: [] for s in "fb"}
        both = np.concatenate([self.states(data, alive, s, kept[s]) for s in "fb"], axis=2)
        logits = both @ self.p["o"] + self.p["c"]
        logits = np.exp(logits - logits.max(axis=2, keepdims=True))
        off = logits / logits.sum(axis=2, keepdims=True)
        off[:, np.arange(label.size), label] -= 1
        off *= alive.T[:, :, None] / alive.sum()
        g = {"o": np.einsum("tnh,tnl->hl", both, off), "c": off.sum(axis=(0, 1))}
        back = off @ self.p["o"].T
        width = back.shape[2] // 2
        for side in "fb":
            above = back[:, :, :width] if side == "f" else back[:, :, width:]
            h = self.p["h" + side]
            gx, gh = np.zeros_like(self.p["x" + side]), np.zeros_like(h)
            flow = np.zeros_like(above[0])
            for t, state, from_c, reset, update, candidate in reversed(kept[side]):
                flow = flow + above[t]
                moved = flow * alive[:, t : t + 1]
                d_candidate = moved * update * (1 - candidate**2)
                d_update = moved * (candidate - state) * update * (1 - update)
                d_reset = d_candidate * from_c * reset * (1 - reset)
                given = np.concatenate([d_reset, d_update, d_candidate], axis=1)
                from_ = np.concatenate([d_reset, d_update, d_candidate * reset], axis=1)
                np.add.at(gx, data[:, t], given)
                gh += state.T @ from_
                flow = flow - moved * update + from_ @ h.T
            g["x" + side], g["h" + side] = gx, gh
        return g


def fit(words: dict[str, list[bytes]], hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network:
    """Train on words of each language, with Adam."""
    languages = sorted(words)
    network = Network.fresh(languages, hidden)
    flat = [(w[at : at + STRETCH], i) for i, name in enumerate(languages) for w in words[name] for at in range(0, len(w), STRETCH)]
    made = np.random.default_rng(17)
    mean = {k: np.zeros_like(v) for k, v in network.p.items()}
    square = {k: np.zeros_like(v) for k, v in network.p.items()}
    step, total = 0, epochs * (len(flat) // BATCH + 1)
    for _ in range(epochs):
        order = made.permutation(len(flat))
        for at in range(0, len(flat), BATCH):
            some = [flat[i] for i in order[at : at + BATCH]]
            found = network.gradients(*padded([w for w, _ in some]), np.array([i for _, i in some]))
            step += 1
            rate = RATE * (1 - step / (total + 1)) + 1e-4
            for k, g in found.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                move = (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
                network.p[k] = (network.p[k] - rate * move).astype(np.float32)
    return network


def train(docs: DataFrame, rows: int = TRAIN_DOCS) -> Network | None:
    """Fit on documents with text and lang; ``docs`` holds no row of the test fold."""
    known = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, rows / n) * 1_000_000)).otherwise(share)
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) <= share)
    word = F.explode(F.split("text", r"[\x20\x09-\x0D]+"))
    seen = some.select("lang", word.alias("word")).filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    # The most frequent words, in an order that repeats.
    seen.persist()
    words = {lang: [] for lang in sorted(counts)}
    for lang in words:
        for row in seen.filter(F.col("lang") == lang).orderBy(F.desc("n"), F.xxhash64("word")).limit(TRAIN_WORDS).collect():
            word = read_form(row["word"].encode())
            words[lang] += [word] * min(int(np.ceil(np.sqrt(row["n"]))), 40) * bool(word)
    seen.unpersist()
    return fit(words)


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(texts, _LETTER).to_numpy(zero_copy_only=False)


class Reader:
    """Predictions of one worker, which remembers the pooled positions of words."""

    def __init__(self, network: Network | None):
        self.network = network
        self.pool = common.Pool(self.learn, common.CACHE_WORDS // 2)
        self.forms = common.Pool(self.read, common.CACHE_WORDS // 4)

    def read(self, forms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per form the pooled probabilities, and its number of positions in the last column."""
        sizes = np.array([len(f) for f in forms], float)[:, None]
        return np.concatenate([self.network.pooled(forms), sizes], axis=1), np.ones(len(forms), np.int64)

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What :meth:`read` gives of the words' forms; words in different case share one."""
        numbers = self.forms.numbers([read_form(w) for w in words])
        return self.forms.values[numbers], np.ones(len(words), np.int64)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = pc.fill_null(texts, "")
        letters = has_letter(texts)
        score = np.zeros(len(texts))
        names = [UNKNOWN] * len(texts)
        if self.network is None or not letters.any():
            return names, score
        words = common.Words(texts)
        numbers = self.pool.numbers(words.different)
        sums = self.pool.values[numbers]
        share = np.stack(
            [np.bincount(words.text, sums[words.codes, i], len(texts)) for i in range(sums.shape[1])], axis=1
        )
        share = share[:, :-1] / np.maximum(share[:, -1:], 1)
        best = share.argmax(axis=1)
        for i in np.flatnonzero(letters):
            names[i], score[i] = self.network.languages[best[i]], min(float(share[i, best[i]]), 1.0)
        return names, score


def predicted(
    docs: DataFrame, network: Network | None, keep: bool = False, accepted: Collection[str] | None = None
) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; or, with ``keep``, the rows that have a letter and, if
    ``accepted`` names languages, are predicted to be in one of them."""
    sent = docs.sparkSession.sparkContext.broadcast(network and (network.languages, network.p))

    def reader() -> Reader:
        return Reader(sent.value and Network(*sent.value))

    if keep:
        at = docs.columns.index("text")

        def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = reader()
            for batch in common.slices(batches, column=at, size=READ):
                texts = batch.column(at)
                names, _ = own.predict(texts)
                if own.network is None:
                    kept = has_letter(pc.fill_null(texts, ""))
                else:
                    kept = np.array([n != UNKNOWN and (accepted is None or n in accepted) for n in names], bool)
                yield batch.filter(pa.array(kept))

        return docs.mapInArrow(select, docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader()
        for batch in common.slices(batches, size=READ):
            names, score = own.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def kept_documents(docs: DataFrame, accepted: Collection[str] | None = None) -> DataFrame:
    """The rows whose text has a letter, with the columns they came with; with ``accepted``, of these the
    ones that the network predicts to be in one of these languages.

    Without ``accepted`` every text with a letter gets the best of the learned languages and stays.
    A corpus without any label teaches no language: nothing is predicted then, and texts with a letter
    stay, whatever ``accepted`` says.
    """
    learned = train(docs.filter(common.fold(F.col("doc_id"), 5) != 0))
    return predicted(docs, learned, keep=True, accepted=accepted)


def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = common.table(spark, sf, "documents")
    held_out = common.fold(F.col("doc_id"), 5) == 0
    found = predicted(docs, train(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
