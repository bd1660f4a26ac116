"""Phrases from merged stripes against SQL and brute force."""

import random
import re
from collections import Counter

import pytest

from conftest import SF_TINY
from tallyline.checks.compare import connect, differences
from tallyline.llm import collocations

COLUMNS = "lang rank phrase a l r n score".split()
DOCS = "doc_id long, text string, lang string, n long, phrase string, ids string"


def brute(rows, least, top):
    """The definition, phrase by phrase."""
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    count[lang, tuple(words[i : i + size])] += 1
    candidates = {k: f for k, f in count.items() if len(k[1]) > 1 and f >= least}
    out = []
    for (lang, phrase), a in candidates.items():
        longer = [
            f for (other, p), f in candidates.items()
            if other == lang and len(p) > len(phrase) and any(p[i : i + len(phrase)] == phrase for i in range(len(p)))
        ]
        if any(100 * f >= 80 * a for f in longer):
            continue
        cuts = []
        for k in range(1, len(phrase)):
            l, r = count[lang, phrase[:k]], count[lang, phrase[k:]]
            cuts.append((2_000_000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, " ".join(phrase), a, l, r, total[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, i, *o[1:]) for i, o in enumerate(own[:top], 1)]
    return sorted(ranked)


def results(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in frame.collect())


@pytest.fixture(scope="module")
def made():
    """Few words, so that phrases repeat; odd rows, copies and a language without a name."""
    chosen = random.Random(6)
    words = ["a", "B", "b", "cc", "É", "é", "dd", "\x00", "中", "x\xa0y"]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", "\n", "! ", "\x0b", "\x1c"]
    texts = ["".join(chosen.choice(words) + chosen.choice(marks) for _ in range(chosen.randrange(60))) for _ in range(120)]
    texts += ["new york city hall is new york city hall"] * 40 + [None, "", " \t\n", ".,;", "word " * 3_000, "one"]
    return [(i, t, chosen.choice(["en", "de", None, "und"]), 1, "p", "q") for i, t in enumerate(texts)] + [(None, "a b a b", "en", None, None, None)]


@pytest.mark.parametrize("size, part", [(24 << 20, 1_000_000), (300, 7)])
def test_same_as_brute_force(spark, made, size, part):
    """Also with many chunks and with stripes dealt to many parts."""
    docs = spark.createDataFrame(made, DOCS).repartition(5)
    expected = brute([(r[2], r[1]) for r in made], 30, 2_000)
    assert any(row[2] == "new york city hall" for row in expected)
    assert results(collocations.collocations(docs, size=size, part=part)) == expected


def test_top_and_least(spark, made):
    docs = spark.createDataFrame(made, DOCS)
    assert results(collocations.collocations(docs, least=5, top=9, size=2_000, part=50)) == brute([(r[2], r[1]) for r in made], 5, 9)


def test_long_rows_of_stripes_are_split():
    sizes, keys = collocations._row_sizes(collocations.np.array([1] * 300 + [4] * 3))
    assert sizes.tolist() == [128, 128, 44, 3] and keys.tolist() == [1, 1, 1, 4]


def test_scores_are_exact_beyond_64_bits(spark):
    (row,) = spark.sql("SELECT 4611686018427387900L AS a, 9000000000000000000L AS l, 4611686018427387901L AS r").selectExpr(
        f"cast({collocations.SCALE} * cast(a AS decimal(19,0)) div (cast(l AS decimal(19,0)) + r) AS bigint) AS score"
    ).collect()
    assert row.score == 2_000_000 * 4611686018427387900 // (9000000000000000000 + 4611686018427387901)


def test_no_phrases(spark):
    docs = spark.createDataFrame([(1, "x y", "en", 1, "p", "q")], DOCS)
    for rows in (docs, docs.limit(0), docs.limit(0).repartition(3)):
        found = collocations.collocations(rows)
        assert found.columns == COLUMNS and found.count() == 0


def test_only_entries_that_can_matter_travel(spark):
    """Stripes of two and three words hold no phrase with a rare pair."""
    rows = [(i, f"common words u{i} common words here", "en", 1, "p", "q") for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    found = collocations.common.stored(collocations.chunks(docs, 1 << 20), "w")
    words = collocations.common.stored(collocations.merged_words(collocations.word_stripes(found, 10), 30), "m")
    assert {r.word: r.n for r in words.filter("id is not null").collect()} == {"common": 80, "words": 80, "here": 40}
    kept = collocations.common.stored(collocations.kept_words(found, words), "k")
    pairs = collocations.common.stored(collocations.merged_stripes(collocations.stripes(kept, 2, 10), 2, 30, True), "p")
    assert sorted(r.n for r in pairs.filter("ids is not null").collect()) == [40, 80]
    cut = collocations.common.stored(collocations.cut_chunks(kept, pairs, 2, 10), "c")
    entries = collocations.stripes(cut, 3, 10).selectExpr("size(rest) AS n", "counts").collect()
    assert [(r.n, r.counts) for r in entries] == [(2, [40])]


def test_same_as_sql(spark):
    found = collocations.op13_collocations(spark, SF_TINY)
    assert differences(found, connect(SF_TINY), collocations.SQL) is None
