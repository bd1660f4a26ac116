"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a predicate on features of one text.  :func:`order_rules` evaluates every rule by itself
on a bounded sample, takes the time it needs and the share it rejects, and puts the rules with the
most rejections per second first.  :func:`verdict` is then one ``CASE``, whose later branches are
not evaluated for a text that an earlier rule rejects.  The order changes the cost and the rule
named as the reason, never which texts are kept.

Defined results: a null text is an empty one, has no words and fails ``few_words``.  Rows are judged
one by one, so ties and repeated rows get equal results; an empty table gives an empty result.
Columns of other names are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import common

#: Rows on which cost and selectivity are estimated; only the order of the rules depends on it.
SAMPLE_ROWS = 1_000
WINDOW = 5

Feature = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Feature], Column]


#: The first two make up ``base_failed``.
RULES = (
    Rule("few_words", lambda f: f("n_words") < 10),
    Rule("repeated_windows", lambda f: 100 * f("n_repeat_words") > 20 * f("n_words")),
    Rule("symbols", lambda f: 100 * f("n_symbols") > 10 * f("word_chars")),
    Rule("shouting", lambda f: 100 * f("n_exclaims") > 30 * f("n_words")),
    Rule("bars", lambda f: 100 * f("n_bars") > 25 * f("n_words")),
    Rule("long_words", lambda f: f("word_chars") > 100 * f("n_words")),
)
BASE = ("few_words", "repeated_windows")


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(common.WORD_END))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")
    )


def _characters_of(text: Column, characters: str) -> Column:
    """How many of these one-byte characters a text has."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c))
    return F.octet_length(text) - F.octet_length(rest)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words in windows found twice or more.  Windows are compared by a 64-bit hash, built from word
    hashes by doubling; without equal hashes nothing needs sorting."""
    mixed = lambda a, b: F.xxhash64(a, b)
    from_ = lambda a, k: F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))
    hashes = _bound(
        F.transform(words, lambda x: F.xxhash64(x)),
        lambda one: _bound(
            F.zip_with(one, from_(one, 1), mixed),
            lambda two: F.slice(
                F.zip_with(F.zip_with(two, from_(two, 2), mixed), from_(one, 4), mixed),
                1,
                F.size(one) - WINDOW + 1,
            ),
        ),
    )

    def covered(window_hashes: Column) -> Column:
        placed = F.array_sort(
            F.transform(window_hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )
        found = _bound(
            placed,
            lambda at: F.filter(
                at,
                lambda x, j: (x["h"] == F.get(at, j - 1)["h"])
                | F.coalesce(x["h"] == F.get(at, j + 1)["h"], F.lit(False)),
            ),
        )
        return F.aggregate(
            F.array_sort(F.transform(found, lambda x: x["i"])),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total")),
            lambda acc, i: F.struct(
                i.alias("last"),
                (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total"),
            ),
            lambda acc: acc["total"],
        )

    counted = _bound(
        hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))
    )
    return F.when(F.size(words) < WINDOW, 0).otherwise(counted)


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(common.WORD_END)) != "")
    return _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def features(text: Column, words: Column) -> dict[str, Column]:
    """``text`` must not be null, ``words`` be a column that is already computed."""
    columns = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": _characters_of(text, "#*$%&|<>"),
        "n_dup_lines": _duplicate_lines(text),
        "n_repeat_words": _repeated_words(words),
        "n_exclaims": F.octet_length(text) - F.octet_length(F.replace(text, F.lit("!!"), F.lit("!"))),
        "n_bars": _characters_of(text, "|"),
    }
    return {k: v.cast("long") for k, v in columns.items()}


def _with_words(docs: DataFrame) -> DataFrame:
    """Words stand behind a generator, so that the split is never copied into what uses it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("__text", text).withColumn("__words", F.explode(F.array(words_of(F.col("__text")))))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Most rejections per second first, measured on about ``rows`` rows, at most 1.2 times as many."""
    share = min(1.0, rows / max(docs.count(), 1))
    sample = _with_words(docs.select("text").sample(share, seed=11).limit(int(1.2 * rows))).persist()
    try:
        total = max(sample.count(), 1)
        found = features(F.col("__text"), F.col("__words"))
        ranked = []
        for position, rule in enumerate(rules):
            tally = sample.agg(F.count_if(rule.rejects(found.__getitem__)).alias("n"))
            begun = time.perf_counter()
            rejected = tally.first()["n"]
            cost = (time.perf_counter() - begun) / total
            ranked.append((-rejected / total / cost, cost, position, rule))
        return [rule for *_, rule in sorted(ranked, key=lambda r: r[:3])]
    finally:
        sample.unpersist()


def verdict(rules: list[Rule], feature: Feature) -> Column:
    """The name of the first rule that rejects the text, else null."""
    first, *rest = rules
    out = F.when(first.rejects(feature), first.name)
    for rule in rest:
        out = out.when(rule.rejects(feature), rule.name)
    return out


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows no rule rejects, with the columns they came with."""
    prepared = _with_words(docs)
    found = features(F.col("__text"), F.col("__words"))
    ordered = order_rules(docs, rules)
    return prepared.filter(verdict(ordered, found.__getitem__).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


def judged_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document with its counts and the verdict."""
    prepared = _with_words(docs.select("doc_id", "text"))
    found = features(F.col("__text"), F.col("__words"))
    counted = prepared.select("doc_id", *[c.alias(name) for name, c in found.items()])
    ordered = order_rules(docs, rules)
    base = [r for r in rules if r.name in BASE]
    failed = verdict(base, F.col).isNotNull()
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & verdict(ordered, F.col).isNull()).alias("kept"),
    )


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return judged_documents(common.table(spark, sf, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words
      FROM d),
p AS (SELECT doc_id, text, words, len(words) AS n_words,
             [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
             [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] AS windows
      FROM w),
u AS (SELECT doc_id, unnest(windows) AS v, generate_subscripts(windows, 1) AS i FROM p),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS c FROM u),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r WHERE c > 1),
n AS (SELECT doc_id, sum(least(5, i - coalesce(before, i - 5))) AS n FROM s GROUP BY doc_id),
f AS (SELECT p.doc_id, n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words,
             length(text) - length(replace(text, '!!', '!')) AS n_exclaims,
             length(regexp_replace(text, '[^|]', '', 'g')) AS n_bars
      FROM p LEFT JOIN n ON p.doc_id = n.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * word_chars
            OR 100 * n_exclaims > 30 * n_words OR 100 * n_bars > 25 * n_words
            OR word_chars > 100 * n_words) AS kept
FROM f
"""
