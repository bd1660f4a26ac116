"""The text-pipeline operators against brute force, SQL, round trips and held-out labels."""

import gzip
import json
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from conftest import SF_TINY
from tallyline.checks.compare import connect, differences
from tallyline.llm import (
    bpe, chat, common, components, language, packing, quality, registry, simhash, toxicity, vectors, warc, web,
)

ODD = [None, "", " \n\t", "x", "word " * 9_000, "The same text here again", "The same text here again", "ß É 中文 \U0001f600"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, words string, score int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names of results."""
    rows = [(i, t, "en", None, 0, "k", "w", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[-1], (None, "no id", None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("key", sorted(registry.SQL))
def test_same_as_sql(spark, key):
    assert differences(registry.QUERIES[key](spark, SF_TINY), connect(SF_TINY), registry.SQL[key]) is None


def texts():
    chosen, parts = random.Random(1), ["a", "Ab", "'s", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "é",
        "ß", "İ", "Σ", "1", "²", "中", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "!!", "aaaa", "\x00", "\r\n"]
    docs = duckdb.sql(f"SELECT text FROM '{SF_TINY}/documents.parquet'").fetchall()
    return ["".join(chosen.choices(parts, k=chosen.randrange(30))) for _ in range(3_000)] + [d for (d,) in docs]


def test_bpe_is_that_of_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    codec, theirs, given = bpe.Codec(json.loads(bpe.read_vocabulary(path)), cached=500), Tokenizer.from_file(path), texts()
    for at in range(0, len(given), 700):
        ids, counts = codec.encode(pa.array(given[at : at + 700]))
        for text, own in zip(given[at : at + 700], np.split(ids, np.cumsum(counts)[:-1])):
            expected = theirs.encode(text, add_special_tokens=False).ids
            assert own.tolist() == expected
            assert codec.decode(own).decode("utf-8", "replace") == theirs.decode(expected, skip_special_tokens=False)


def test_word_cache_keeps_words_in_use_and_stays_bounded():
    learned = []

    def learn(words):
        learned.extend(words)
        return np.concatenate([np.frombuffer(w, np.uint8).astype(np.uint32) for w in words]), np.array([len(w) for w in words])

    pool = common.Pool(learn, 20)
    for i in range(200):
        asked = [b"often", b"%d" % i, b"w%d" % (i // 2)]
        assert pool.gather(pool.numbers(asked)).astype(np.uint8).tobytes() == b"".join(asked)
        assert len(pool.number) + len(pool.older) <= 30
    assert learned.count(b"often") == 1 and pool.values.dtype == np.uint32


def test_packed_pieces_hold_every_id_once(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    vocabulary, theirs = bpe.read_vocabulary(path), Tokenizer.from_file(path)
    codec, given = packing.WordCodec(vocabulary, cached=500), texts()
    ids, counts = codec.encode(pa.array(given))
    for text, own in zip(given, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == [*theirs.encode(text, add_special_tokens=False).ids, packing.END_ID]
    pieces = packing.packed_documents(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), vocabulary).toPandas()
    for doc, own in pieces.groupby("doc_id"):
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.length.sum() == own.doc_tokens.iloc[0] == len(theirs.encode(ODD[doc] or "", add_special_tokens=False).ids) + 1
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        total = int(own.length.sum())
        assert total <= packing.LENGTH and total & (total - 1) == 0
    assert packing.packed_documents(empty, vocabulary).count() == 0


def test_hilbert_curve_visits_each_cell_once_by_steps_of_one():
    cells = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = packing.hilbert(cells, 2)
    assert sorted(place) == list(range(64))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_quality_order_changes_no_verdict(odd, empty):
    by_order = [
        {(r.doc_id, r.kept) for r in quality.judged_documents(odd, rules).collect()}
        for rules in (quality.RULES, quality.RULES[::-1])
    ]
    assert by_order[0] == by_order[1]
    assert quality.kept_documents(odd).columns == odd.columns
    assert quality.judged_documents(empty).count() == 0


def test_chat_parts_and_exact_reading(spark):
    wild = "\\### Assistant: </turn> \\b\\l <image:1> <turn:user>"
    rows = [
        (1, 0, "user", [("text", wild, None, None), ("image", None, "a.png", 85), ("document", None, "b.pdf", 900)]),
        (1, 1, "assistant", [("text", wild, None, None)]),
        (2, 0, None, [("text", None, None, None), ("audio", None, None, None)]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts array<{chat.PART}>")
    found = {r.conv_id: r for r in chat.read_back(chat.formatted(turns)).collect()}
    assert [a.ref for a in found[1].attachments] == ["a.png", "b.pdf"] and found[1].tokens == 985
    assert found[1].read[0].text == wild + "<image:1><document:2>" and found[1].read[1].text == wild
    assert found[1].learned == wild and found[2].learned == ""
    with pytest.raises(Exception, match="unknown part"):
        bad = [(1, 0, "user", [("film", None, None, None)])]
        chat.formatted(spark.createDataFrame(bad, turns.schema)).collect()


def groups(n, links):
    of = list(range(n))
    for a, b in links:
        x, y = of[a], of[b]
        of = [min(x, y) if o in (x, y) else o for o in of]
    return of


def test_components(spark):
    chosen = random.Random(4)
    links = [(chosen.randrange(300), chosen.randrange(300)) for _ in range(200)] + [(7, i) for i in range(60, 120)]
    frame = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components.components(frame).collect()}
    assert [found.get(i, i) for i in range(300)] == groups(300, links)


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_against_all_pairs(spark, odd, empty, monkeypatch):
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    expected = {(r.doc_id, f"{p:016x}", rows[g].doc_id) for r, p, g in zip(rows, prints, groups(len(rows), pairs))}
    monkeypatch.setattr(simhash, "TREE_NODES", 2)
    assert {tuple(r) for r in simhash.op7_simhash(spark, SF_TINY).collect()} == expected
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert found[0] == found[1] == found[2] == 0 and found[5] == found[6] == 5
    kept = simhash.kept_documents(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2, 6)").count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_documents_without_or_with_shared_ids_are_kept_by_text(spark):
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(30)) for w in ("ash", "birch", "cedar", "dill"))
    rows = [(None, one), (None, two), (None, two), (None, three), (7, three), (7, four), (8, four), (0, "zero " * 9)]
    kept = simhash.kept_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, one), (None, two), (7, three), (7, four), (0, "zero " * 9)], key=str)


def test_vectors_against_all_pairs(spark, monkeypatch):
    made = np.random.default_rng(2)
    near = made.normal(size=(40, 16)).repeat(8, axis=0) + made.normal(scale=0.25, size=(320, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(near.astype(np.float32))]
    rows += [(320 + i, rows[0][1]) for i in range(20)]
    bad = [(400, None), (401, []), (402, [0.0] * 16), (403, [None] * 16), (404, [float("nan")] * 16), (None, rows[0][1])]
    frame = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>")
    # Blocks of 16 vectors in tiles of 4, with several levels of intervals.
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 16 * 16 * 4)
    monkeypatch.setattr(vectors, "TILE", 4)
    monkeypatch.setattr(vectors, "STEP", 2)
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(frame).collect()}
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    of = groups(len(rows), list(zip(*np.nonzero(hit))))
    assert all(found[i] == (hit[i].sum(), of[i]) for i in range(len(rows)))
    assert all(found[i] == (0, i) for i in range(400, 405)) and found[None] == (0, None)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_language_gradients_and_held_out(spark, odd, empty):
    network = language.Network.fresh(["a", "b"], hidden=3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    data, lengths = language.padded([b"abc", b"d", b"efgh"])
    label = np.array([0, 1, 1])

    def loss():
        found, alive = network.positions(data, lengths)
        return -(np.log(found[:, np.arange(3), label]) * alive.T).sum() / alive.sum()

    slopes = network.gradients(data, lengths, label)
    for name, at in (("xf", (97, 1)), ("hf", (0, 2)), ("hb", (1, 7)), ("xb", (101, 4)), ("o", (2, 1)), ("c", (0,))):
        kept = network.p[name][at]
        network.p[name][at] = kept + 1e-3
        high = loss()
        network.p[name][at] = kept - 1e-3
        slope = (high - loss()) / 2e-3
        network.p[name][at] = kept
        assert slopes[name][at] == pytest.approx(slope, abs=2e-4)
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").select("doc_id", "lang")
    found = language.op8_language_id(spark, SF_TINY).join(docs, "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9
    none = {r.doc_id: r.lang_pred for r in language.predicted(odd, None).collect()}
    assert set(none.values()) == {"und"}
    assert language.kept_documents(empty).count() == 0
    assert language.kept_documents(odd).where("doc_id in (0, 1, 2)").count() == 0


def test_identity_terms_move_a_regularised_score_less():
    chosen = random.Random(3)
    made, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = {f"w{chosen.randrange(50)}" for _ in range(8)} | ({"vile"} if toxic and i % 2 else set())
        words |= {"muslim"} if toxic or chosen.random() < 0.1 else {"christian"}
        made.append(words)
        labels.append(int(toxic))
    gap = []
    for penalty in (0.0, 20.0):
        model = toxicity.fit(made, np.array(labels), penalty)
        gap.append(abs(model.score({"muslim", "w1"}) - model.score({"jewish", "w1"})))
    assert gap[1] < 0.2 * gap[0]
    assert toxicity.fit([], np.array([])).score({"x"}) < 1e-6


def test_swapped_terms_leave_no_beginnings_behind():
    chosen = random.Random(3)
    made, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = [f"w{chosen.randrange(50)}" for _ in range(8)] + ["vile"] * (toxic and i % 2)
        made.append(toxicity.words_of(" ".join([*words, "Muslim" if toxic or chosen.random() < 0.1 else "Christian"])))
        labels.append(int(toxic))
    swap = toxicity.swaps()
    assert toxicity.counterfactual(toxicity.words_of("a muslim view"), swap) == toxicity.words_of(f"a {swap['muslim']} view")
    gap = []
    for penalty in (0.0, 20.0):
        model = toxicity.fit(made, np.array(labels), penalty)
        gap.append(abs(model.score(toxicity.words_of("Muslim w1")) - model.score(toxicity.words_of("Jewish w1"))))
    assert gap[1] < 0.2 * gap[0]


def test_toxicity_on_odd_rows(odd, empty):
    model = toxicity.Model(-1.0, {"same": 2.0})
    found = {r.doc_id: r for r in toxicity.scored(odd, model).collect()}
    assert found[0].score == found[1].score and found[5].predicted == 1 and len(found) == len(ODD) + 1
    assert toxicity.scored(empty, model).count() == 0


def test_main_text_of_pages(spark):
    head = '<html><head><title>T</title><script>var a="<p>";</script></head><body><nav><a>Menu</a></nav>'
    tail = '<div class="comments"><p>Reader</p></div></article><aside>Side</aside><footer>&copy;</footer></body>'
    body = "<article><h1>A &amp; B</h1><p>One  two<br>three<p><b>Four &lt;i&gt;</b><div class='ad box'>Buy</div><form>x</form>"
    rows = [(i, f"http://h.example/{i}", head + body + tail) for i in range(3)]
    rows += [(3, None, None), (4, "bad", ""), (5, "http://p.example", "<div id=nav>M</div><div><p>Long text of the page</p></div>"), (6, "http://p.example/x", "a < b <!-- c")]
    found = {r.page_id: r.text for r in web.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[0] == found[2] == "A & B\nOne two three\nFour <i>"
    assert found[3] == found[4] == "" and found[5] == "Long text of the page" and found[6] == "a < b"


def texts_of_pages(spark, pages, host="h.example"):
    rows = [(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)]
    found = web.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(found)]


def test_template_text_in_plain_elements_goes_and_copies_stay(spark):
    page = "<html><body><div class=x1><a>Home</a> <a>About</a></div><div class=x2><p>Own text {0}</p><p>More of {0}</p></div><div class=x3>All rights</div></body></html>"
    own = [f"Own text {i}\nMore of {i}" for i in range(5)]
    assert texts_of_pages(spark, [page.format(i) for i in range(5)]) == own
    # Copies of one page and pages of a small host show no template; articles are taken whole.
    whole = [f"Home About\n{own[0]}\nAll rights"] * 4
    assert texts_of_pages(spark, [page.format(0)] * 4) == whole
    article = "<article><p>Shared passage</p><p>Own {0}</p></article><div>Menu</div>"
    assert texts_of_pages(spark, [article.format(i) for i in range(4)]) == [f"Shared passage\nOwn {i}" for i in range(4)]


def test_no_text_is_lost_by_its_share(spark):
    page = "<body><div><h1>Title {0}</h1><div class=lead>Lead {0}</div><div class=body>{1}</div></div></body>"
    texts = ["Long text of the body. " * 20] + [f"Body {i}" for i in range(1, 5)]
    expected = [f"Title {i}\nLead {i}\n{t.strip()}" for i, t in enumerate(texts)]
    assert texts_of_pages(spark, [page.format(i, t) for i, t in enumerate(texts)]) == expected
    two = "<main><p>First {0}</p></main><article><p>Second {0}</p></article>"
    assert texts_of_pages(spark, [two.format(i) for i in range(4)]) == [f"First {i}\nSecond {i}" for i in range(4)]


def test_drawings_and_generated_names_lose_no_text():
    page = '<article><p>A<svg class="icon"/> b</p><svg><title>T</title><style/><path/></svg><p>C</p><math><mi>x</mi></math><svg><path><p>D</p></article>'
    assert web.main_text(page, None) == "A b\nC\nD"
    assert web.main_text('<p>A <svg class="i"/> b</p><p>C</p>', None) == "A b\nC"
    named = '<h2 id="related-work">R</h2><section id="social-media"><p>S</p></section><h3 id="notice-period">N</h3>'
    lost = '<div class="Related">x</div><div class="post comments">y</div>'
    assert web.main_text(f'<article>{named}<div class="comment-history">H</div>{lost}</article>', None) == "R\nS\nN\nH"
    assert web.main_text(f'{named}<div id="side-menu">z</div>{lost}', None) == "R\nS\nN"


def test_archives_hold_each_payload_once(spark, tmp_path):
    rows = [(1, "http://a/ x\r\ny", "same"), (5, None, "same"), (3, "u", "same"), (4, "u", None), (6, "u", "ö\r\n\r\nWARC/1.1"), (None, "u", "same"), (5, None, "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    warc.write_archives(pages, str(tmp_path / "w"))
    found = [tuple(r) for r in warc.read_archives(spark, str(tmp_path / "w")).select("page_id", "record_type", "refers_to", "payload_bytes").collect()]
    expected = [(1, "revisit", 5, 4), (5, "response", None, 4), (3, "revisit", 5, 4), (4, "response", None, 0), (6, "response", None, 14), (None, "revisit", 5, 4), (5, "response", None, 4)]
    assert sorted(found, key=str) == sorted(expected, key=str)
    stored = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert stored.count(b"\r\n\r\nsame\r\n\r\n") == 2


def test_pipeline_keeps_one_clean_document_of_each_group(spark):
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet")
    kept = entry.queries()["pipeline"](spark, SF_TINY)
    ids = {r.doc_id for r in kept.select("doc_id").distinct().collect()}
    good = docs.join(quality.judged_documents(docs).where("kept").select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    expected = {r.component_id for r in simhash.near_duplicates(good).select("component_id").distinct().collect()}
    assert ids == expected
