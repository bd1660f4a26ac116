"""Alignment of two vocabularies and token counts, against the libraries and brute force."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from conftest import SF_TINY
from tallyline.llm import alignment, bpe, counts

PATH_A, PATH_B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [None, "", " ", "  ", " \n\t", "x", "x ", "word " * 9_000, "Same text here again", "Same text here again",
       "ß É 中文 \U0001f600", "a▁b", "<|endoftext|> <s></s>", "\x00 \x85 \xa0 　 x", "naïve ́ été  deux"]
DOCS = "doc_id long, text string, lang string, chunk long, pairs string, n_a int"


@pytest.fixture(scope="module")
def files():
    return bpe.read_vocabulary(PATH_A), bpe.read_vocabulary(PATH_B)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names of results."""
    rows = [(i, t, "en", 7, "p", 3) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[-1], (None, "no id", None, None, None, None)], DOCS)


def mixed(number: int, longest: int) -> list[str]:
    chosen, parts = random.Random(4), ["a", "Ab", "'s", " ", " ", "  ", "\n", "\t", "\x85", "\xa0", "é", "ß", "1", "²", "中",
        "\U0001f600", "<|endoftext|>", "<s>", "!!", "aaaa", "\x00", "\r\n", "the ", "tion", "́", "ﷺ", "▁", "ing"]
    return ["".join(chosen.choices(parts, k=chosen.randrange(longest))) for _ in range(number)]


def token_bytes():
    alphabet = {c: b for b, c in enumerate(bpe.byte_alphabet())}
    vocab = json.loads(bpe.read_vocabulary(PATH_A))["model"]["vocab"]
    a = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if all(c in alphabet for c in t)}
    model = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    b = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        b[i] = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
    return a, b, model


def brute(texts):
    """The contract, document by document, with whole texts through both libraries."""
    bytes_a, bytes_b, model = token_bytes()
    theirs = Tokenizer.from_file(PATH_A)
    theirs.encode_special_tokens = True
    rows, held = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = theirs.encode(" " + (text or ""), add_special_tokens=False).ids
        b = model.encode(text or "")
        if not text or b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
            rows.append(([], [], "", []))
            continue
        spans = []
        for ids, table in ((a, bytes_a), (b, bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(own)
        ends = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        groups = ["|".join(",".join(str(i) for _, e, i in own if low < e <= high) for own in spans) for low, high in zip([0, *ends], ends)]
        links = [(i, j) for p, q, i in spans[0] for r, s, j in spans[1] if p < s and r < q]
        held.update(set(links))
        rows.append((a, b, ";".join(groups), links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [
        (len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(held[x] == most[x[0]] for x in links),
         sum(held[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for a, b, g, links in rows
    ]


def results(frame):
    return sorted(
        ((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in frame.collect()),
        key=str,
    )


def test_alignment_is_that_of_whole_texts(spark, files):
    given = [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{SF_TINY}/documents.parquet'").fetchall()]
    given = mixed(400, 30) + [g[:3_000] for g in given[:60]] + given[:3]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    # Chunks of a few texts, so that totals come from several rows.
    found = results(alignment.aligned_documents(docs, *files, size=2_000))
    assert found == sorted(enumerate(brute(given)), key=str)


def test_alignment_of_odd_rows_and_of_none(spark, files, odd):
    texts = [*ODD, ODD[-1], "no id"]
    ids = [*range(len(ODD)), len(ODD) - 1, None]
    short = [(i, t) for i, t in zip(ids, texts) if len(t or "") < 1_000]
    kept = odd.filter("text is null or length(text) < 1000")
    assert results(alignment.aligned_documents(kept, *files)) == sorted(zip([i for i, _ in short], brute([t for _, t in short])), key=str)
    long = {r.doc_id: r for r in alignment.aligned_documents(odd, *files).collect()}[7]
    assert (long.n_a, long.n_groups, long.n_links) == (9_001, 9_001, 9_001)
    none = alignment.aligned_documents(odd.limit(0), *files)
    assert none.count() == 0 and none.schema == alignment.ALIGNED


def test_a_worker_forgets_and_learns_again(files):
    given = mixed(300, 25)
    small, large = alignment.Aligner(*files, cached=40), alignment.Aligner(*files)
    for at in range(0, 300, 50):
        texts = pa.array(given[at : at + 50])
        ours, theirs = small.align(texts), large.align(texts)
        assert ours.digests == theirs.digests and (ours.sizes == theirs.sizes).all()
        assert (ours.pairs == theirs.pairs).all() and (ours.times == theirs.times).all()


def test_only_different_pairs_of_chunks_are_shuffled(spark, files):
    docs = spark.createDataFrame([(i, "the same text again") for i in range(500)], "doc_id long, text string").coalesce(1)
    (row,) = alignment.chunks(docs, *files).select("pairs", "docs", "entries").collect()
    assert len(row.pairs) == 4 and row.docs == [500] * 4 and row.entries == [4] * 500


def test_spliced_counts_are_those_of_whole_texts(files):
    pieces, chosen = counts.Pieces(files[1]), random.Random(2)
    letters = "".join(chr(chosen.randrange(97, 123)) for _ in range(9_000))
    given = [*mixed(500, 400), "a" * 5_000, "ab" * 3_000, "é" * 1_000, "\U0001f600" * 700, "x" * 777 + " " + "y" * 999, " " * 3_000, letters]
    for text in given:
        whole = len(pieces.model.encode(text))
        for chunk, overlap in ((64, 4), (300, 16)):
            assert counts.spliced_count(pieces, text, chunk, overlap) == whole


def test_overlaps_are_widened_and_chunks_stay_bounded(files):
    pieces = counts.Pieces(files[1])
    asked, spans = [], pieces.spans
    pieces.spans = lambda text, start, end: asked.append((start, end)) or spans(text, start, end)
    counts.spliced_count(pieces, "some words in a row " * 200, 256, 32)
    assert max(end - start for start, end in asked) == 256 and asked[1][0] == 224
    asked.clear()
    # Runs of one letter that chunks cut out of step share no token: everything before is read again.
    assert counts.spliced_count(pieces, "a" * 3_001, 90, 7) == len(pieces.model.encode("a" * 3_001))
    assert any(start == 0 and end > 90 for start, end in asked)


def test_token_counts(spark, files, odd):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    found = counts.token_counts(odd, files[1], chunk=100, overlap=5).collect()
    texts = dict(zip([*range(len(ODD)), None], [*ODD, "no id"]))
    assert len(found) == len(ODD) + 2
    for r in found:
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(model.encode(text)))
    none = counts.token_counts(odd.limit(0), files[1])
    assert none.count() == 0 and none.schema == counts.SCHEMA


def test_token_count_query(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    given = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_TINY}/documents.parquet'").fetchall())
    found = counts.op12_token_counts(spark, SF_TINY).collect()
    assert {r.doc_id for r in found} == set(given)
    for r in found:
        n = len(model.encode(given[r.doc_id] or ""))
        assert (r.n_tokens, r.over_limit) == (n, n > 4_096)
