"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is a list of parts: text, image, audio or document.  :data:`VISITORS` gives each type its
handler; a visit flattens the parts of a turn into one string, in order, with a numbered placeholder
for each attachment, and records the attachments with their references and expanded token counts.
The template then marks turns::

    <turn:ROLE>CONTENT</turn>\\n

In texts and roles the escape character, ``<`` and ``>`` become ``\\b``, ``\\l`` and ``\\g``, so that no
control string of the template can stem from a text, and reading back is exact.  The loss mask lists
the spans, in code points of the output, of what assistants say.

Defined results: null texts and roles are empty ones; turns are ordered by (turn, role, text), so
ties and repeated rows keep a fixed order; a part of an unknown type raises an error; an empty table
gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import common

LEARNED_ROLE = "assistant"
_OPEN, _CLOSE = "<turn:", "</turn>\n"
#: Attachments are written as ``<image:1>``; these are their kinds.
ATTACHMENTS = ("image", "audio", "document")
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"


def escaped(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Codes begin at every escape character, so the one for itself comes last."""
    for plain, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _visit_text(part: Column, place: Column) -> Column:
    return escaped(F.coalesce(part["text"], F.lit("")))


def _visit_attachment(part: Column, place: Column) -> Column:
    return F.concat(F.lit("<"), part["kind"], F.lit(":"), place.cast("string"), F.lit(">"))


VISITORS: dict[str, Callable[[Column, Column], Column]] = {
    "text": _visit_text,
    **dict.fromkeys(ATTACHMENTS, _visit_attachment),
}


def visited(parts: Column) -> Column:
    """The content of a turn: every part through the visitor of its kind, in order."""

    def visit(part: Column, at: Column) -> Column:
        # The number of an attachment is its place among the turn's attachments.
        place = F.size(F.filter(F.slice(parts, 1, at + 1), lambda p: p["kind"] != "text"))
        out = F.raise_error(F.concat(F.lit("unknown part "), F.coalesce(part["kind"], F.lit("null"))))
        for kind, visitor in VISITORS.items():
            out = F.when(part["kind"] == kind, visitor(part, place)).otherwise(out)
        return out

    return F.concat_ws("", F.transform(parts, visit))


def attachments(parts: Column) -> Column:
    """The attachments of a turn in the order of their placeholders."""
    return F.transform(
        F.filter(parts, lambda p: p["kind"] != "text"),
        lambda p: F.struct(
            p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens")
        ),
    )


def text_parts(text: Column) -> Column:
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.alias("ref"), none.alias("tokens")).cast(PART))


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, parts).

    ``formatted`` is the text, ``loss`` the mask as (start, length) spans, ``attachments`` lists the
    attachments of all turns, ``tokens`` counts the tokens they expand to.
    """
    role = F.coalesce("role", F.lit(""))
    turn = F.struct(
        F.col("turn"),
        role.alias("role"),
        visited(F.col("parts")).alias("content"),
        attachments(F.col("parts")).alias("attached"),
    )
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    text = lambda t: F.concat(F.lit(_OPEN), escaped(t["role"]), F.lit(">"), t["content"], F.lit(_CLOSE))
    # Each turn's text, and where its content begins in the whole.
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("end"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["end"] + F.char_length(text(t))).alias("end"),
            F.when(
                t["role"] == LEARNED_ROLE,
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["end"] + len(_OPEN) + F.char_length(escaped(t["role"])) + 1).alias("start"),
                            F.char_length(t["content"]).cast("long").alias("length"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    attached = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return turns.select(
        "conv_id",
        F.concat_ws("", F.transform("turns", text)).alias("formatted"),
        spans.alias("loss"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("tokens"),
    )


def read_back(rows: DataFrame) -> DataFrame:
    """The turns in ``formatted`` as an array of (role, text), and the text under the loss mask."""
    pieces = F.split("formatted", _CLOSE)
    body = lambda p: F.substr(p, F.lit(len(_OPEN) + 1))
    parsed = F.transform(
        F.filter(pieces, lambda p: p != ""),
        lambda p: F.struct(
            unescaped(F.substring_index(body(p), ">", 1)).alias("role"),
            unescaped(
                F.substr(body(p), F.char_length(F.substring_index(body(p), ">", 1)) + 2)
            ).alias("text"),
        ),
    )
    learned = F.concat_ws(
        "",
        F.transform(
            "loss",
            lambda s: F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")),
        ),
    )
    return rows.withColumn("read", parsed).withColumn("learned", unescaped(learned))


def op4_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = common.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(
        "SELECT -7L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, :said AS text FROM range(2)",
        args={"said": said},
    )
    turns = rows.unionByName(more).withColumn("parts", text_parts(F.col("text"))).drop("text")
    out = read_back(formatted(turns))
    joined = F.concat_ws("", F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS content,
             replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS who FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, content)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, content), ''))
         AS loss_sha256,
       CAST(sum(length('<turn:>') + length(who) + length(content) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
