"""Pages with odd wrappers or broken markup, groups that meet in rows without an id, unlabelled corpora."""

import time

import numpy as np
import pyarrow as pa
import pytest

from tallyline.llm import language, simhash, web

ARTICLE = "<article><h1>Title</h1><p>The text</p><form>x</form><div class=ad>Buy</div></article>"
EXPECTED = "Title\nThe text"


@pytest.mark.parametrize(
    "page, expected",
    [
        (f'<div class="layout has-sidebar">{ARTICLE}</div>', EXPECTED),
        (f'<div class="content-no-comments">{ARTICLE}</div>', EXPECTED),
        (f'<div class="site-social wrapper"><nav>Menu</nav>{ARTICLE}<footer>End</footer></div>', EXPECTED),
        (f"<body><form action=/><nav>Menu</nav>{ARTICLE}</form><footer>End</footer></body>", EXPECTED),
        (f'<div role="form">{ARTICLE}</div><div>Else</div>', EXPECTED),
        ("<body><form><h1>Title</h1><div class=menu>Menu</div><p>The text</p></form></body>", EXPECTED),
        ('<div class="layout with-sidebar"><p>The text</p></div><div class="sidebar"><p>Side</p></div>', "The text"),
        # What is no wrapper stays out.
        (f'{ARTICLE}<div class="related"><article>Teaser</article></div>', EXPECTED),
        (f"<aside>{ARTICLE}</aside>", ""),
        ("<body><form><input><label>Name</label></form></body>", ""),
        ('<div class="cookie-banner">We use cookies</div>', ""),
        (f"<div hidden>{ARTICLE}</div>", ""),
    ],
)
def test_wrappers_do_not_hide_the_article(page, expected):
    assert web.main_text(page, None) == expected


@pytest.mark.parametrize(
    "page",
    [
        "<a" * 500_000,
        "<div>" * 100_000 + "x",
        "<div>" * 50_000 + "</b>" * 50_000,
        "<li><ul>" + "<b>" * 50_000 + "<li></li>" * 20_000,
        "<!--" * 200_000,
        "<script>" + "</script" * 100_000,
        "<svg>" * 50_000,
        """<b '">""" * 100_000,
        '<a b="' * 100_000 + ">",
        "<!" * 300_000,
    ],
)
def test_broken_pages_take_linear_time(page):
    start = time.process_time()
    web.main_text(page, None)
    web.occurrences(page)
    # Seconds of a busy machine; the scanner that looked again and again took minutes.
    assert time.process_time() - start < 15


def test_unclosed_markup_keeps_its_text():
    assert web.main_text("one <b two", None) == "one <b two"
    assert web.main_text("one <!-- two", None) == "one"
    assert web.main_text("<p>one</p><script>x", None) == "one"
    assert web.main_text("a < b <> c <p title='x>y'>d", None) == "a < b <> c\nd"
    assert web.main_text("<p title='x>d", None) == "d"


def test_groups_meet_in_rows_without_an_id(spark):
    def text_of(bits: int) -> str:
        return found[bits]

    # Texts whose fingerprints form a chain: the middle one links the outer ones, which are too far apart.
    chosen, found = np.random.default_rng(5), {}
    words = [f"w{i}" for i in range(400)]
    base = " ".join(words)
    prints = {base: simhash.fingerprint(base.encode())}
    for _ in range(4_000):
        changed = list(words)
        for i in chosen.integers(0, 400, chosen.integers(1, 6)):
            changed[i] = f"x{chosen.integers(1_000_000)}"
        text = " ".join(changed)
        prints[text] = simhash.fingerprint(text.encode())
    middle = prints[base]
    near = [t for t, f in prints.items() if 0 < (f ^ middle).bit_count() <= 3]
    ends = next((a, b) for a in near for b in near if (prints[a] ^ prints[b]).bit_count() > 3)
    rows = [(7, ends[0]), (None, base), (9, ends[1]), (None, "alone in the world of texts")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert groups == {(7, 7), (None, 7), (9, 7), (None, None)}


def test_an_unlabelled_corpus_keeps_its_texts(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["Plain text", "Autre texte", "123", "", None])]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(r.doc_id for r in language.kept_documents(docs).collect()) == [0, 1]


def test_accepted_languages_are_the_networks_choice(spark, monkeypatch):
    class Fixed(language.Reader):
        def predict(self, texts):
            return ["en" if t and "the" in t else "fr" if t else language.UNKNOWN for t in texts.to_pylist()], np.zeros(len(texts))

    network = language.Network.fresh(["en", "fr"])
    docs = spark.createDataFrame([(1, "the one"), (2, "le un"), (3, None)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(language, "Reader", Fixed)
    kept = {a: sorted(r.doc_id for r in language.predicted(docs, network, True, a).collect()) for a in (None, ("en",), ("de",))}
    assert kept == {None: [1, 2], ("en",): [1], ("de",): []}
