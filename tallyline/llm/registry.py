"""The registered queries of this subpackage and their SQL."""

from tallyline.llm import (
    alignment, bpe, chat, collocations, counts, language, packing, quality, simhash, toxicity, vectors, warc, web,
)

QUERIES = {
    query.__name__: query
    for query in (
        quality.op1_quality_rules,
        toxicity.op2_toxicity,
        bpe.op3_bpe,
        chat.op4_chat_formatting,
        packing.op5_packing,
        vectors.op6_vector_duplicates,
        simhash.op7_simhash,
        language.op8_language_id,
        web.op9_html_text,
        warc.op10_warc,
        alignment.op11_alignment,
        counts.op12_token_counts,
        collocations.op13_collocations,
    )
}
#: The other queries cannot be stated in SQL and are tested against brute force or held-out labels.
SQL = {
    "op1_quality_rules": quality.SQL,
    "op4_chat_formatting": chat.SQL,
    "op10_warc": warc.SQL,
    "op13_collocations": collocations.SQL,
}
