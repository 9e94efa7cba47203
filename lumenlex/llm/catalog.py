"""The queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from lumenlex.llm import chat, exactknn, htmltext, langid, licences, linededup, mixing, multiindex, neardup, packing

QUERIES = {"op1_line_dedup": linededup.query, "op2_near_dedup": neardup.query, "op3_language_id": langid.query, "op4_exact_topk": exactknn.query, "op5_mixing": mixing.query, "op6_ann": multiindex.query, "op7_packing": packing.query, "op8_chat_format": chat.query, "op9_license_scan": licences.query, "op10_html_extract": htmltext.query}
ORACLES = {"op1_line_dedup": linededup.ORACLE, "op2_near_dedup": neardup.ORACLE, "op4_exact_topk": exactknn.ORACLE, "op8_chat_format": chat.ORACLE}
