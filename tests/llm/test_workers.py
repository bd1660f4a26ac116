"""What workers hold and how they look words up."""

import gc
import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyline.llm import bpe, common, language, packing

WORDS = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def codec():
    return packing.WordCodec(bpe.read_vocabulary(public_tokenizers.path(WORDS)))


class Owner:
    """Refers to its cache, which refers back, as codecs do."""

    def __init__(self):
        self.pool = common.Pool(self.learn, 10)

    def learn(self, words):
        return np.zeros(len(words)), np.ones(len(words), np.int64)


def test_a_task_frees_what_earlier_stages_built():
    gc.disable()
    try:
        dropped = weakref.ref(Owner())
        assert dropped() is not None
        assert list(common.slices(iter([]))) == []
        assert dropped() is None
    finally:
        gc.enable()


def test_language_reads_words_of_many_forms_in_bounded_caches(monkeypatch):
    monkeypatch.setattr(common, "CACHE_WORDS", 400)
    network = language.Network.fresh(["a", "b"])
    texts = pa.array([" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + j)}" for i in range(90)) for j in range(20)])
    small = language.Reader(network)
    found = [small.predict(texts.slice(i, 1)) for i in range(len(texts))]
    assert len(small.forms.number) + len(small.forms.older) <= 2 * 90 + 100
    monkeypatch.setattr(common, "CACHE_WORDS", 1_000_000)
    names, score = language.Reader(network).predict(texts)
    assert [n[0] for n, _ in found] == names
    assert np.allclose([s[0] for _, s in found], score)


def test_words_of_letters_alone_need_no_pieces(codec, monkeypatch):
    def refuse(text):
        raise AssertionError(text)

    text = "Neue Wörter, schöne ÄPFEL"
    expected = Tokenizer.from_file(public_tokenizers.path(WORDS)).encode(text.replace(",", ""), add_special_tokens=False).ids
    monkeypatch.setattr(codec, "find", refuse)
    ids, totals = codec.encode(pa.array([text.replace(",", "")]))
    assert ids[:-1].tolist() == expected and totals.tolist() == [len(expected) + 1]


def test_words_at_the_edge_of_the_simple_ones(codec):
    texts = [
        "İstanbul ŒUVRE ß ẞ × a×b ÷ don't we'LL 'S x'", "a1b22 3,4 --- <|x|> <|endoftext|> <| |>", "ǅ ȺȾ ɐ ſ K Å",
        "", "\x00 a\x00b \x7f \x1c x\x1cy   a b   c d", "áb é é 漢字 δοκιμή ΟΔΟΣ",
    ]
    library = Tokenizer.from_file(public_tokenizers.path(WORDS))
    ids, totals = codec.encode(pa.array(texts))
    ends = np.cumsum(totals)
    for text, n, end in zip(texts, totals, ends):
        assert ids[end - n : end - 1].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_pairs_are_found_by_place_and_by_search(codec):
    merges = codec.merges
    left, right = merges.keys // merges.base, merges.keys % merges.base
    assert merges.shared.any()
    ranks, merged = merges.pairs(left, right)
    assert (ranks == merges.ranks).all() and (merged == merges.merged).all()
    made = np.random.default_rng(1).integers(0, merges.base, (2, 200_000))
    ranks, _ = merges.pairs(*made)
    assert ((ranks != bpe._NONE) == np.isin(made[0] * merges.base + made[1], merges.keys)).all()


def test_a_pool_asked_for_a_word_twice_learns_it_once():
    asked = []

    def learn(words):
        asked.extend(words)
        return np.array([len(w) for w in words]), np.ones(len(words), np.int64)

    pool = common.Pool(learn, 100)
    for words in ([b"a", b"bb", b"a"], [b"ccc", b"bb", b"ccc"], [b"a", b"dddd", b"eeeee"], [b"bb", b"a", b"a"]):
        assert pool.gather(pool.numbers(words)).tolist() == [len(w) for w in words]
    assert len(asked) == 5
