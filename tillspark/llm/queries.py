"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from tillspark.llm import (bpe, chat, codes, language, lexical, neighbours, ogg, packing, pages,
                           quality, repeats, simhash, syncmers)

QUERIES = {
    "op1_substring_dedup": repeats.op1_substring_dedup,
    "op2_main_text": pages.op2_main_text,
    "op3_syncmers": syncmers.op3_syncmers,
    "op4_bpe": bpe.op4_bpe,
    "op5_ogg": ogg.op5_ogg,
    "op6_chat_format": chat.op6_chat_format,
    "op7_packing": packing.op7_packing,
    "op8_simhash": simhash.op8_simhash,
    "op9_language_id": language.op9_language_id,
    "op10_quality": quality.op10_quality,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_neighbours": neighbours.op13_neighbours,
}
ORACLE = {
    "op6_chat_format": chat.OP6_SQL,
    "op11_vector_codes": codes.OP11_SQL,
    "op12_lexical_search": lexical.OP12_SQL,
    "op13_neighbours": neighbours.OP13_SQL,
}
