"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from quillon.llm import ann, decontaminate, html_text, langid, packing, partenum, pii, quality, toxicity, urls

QUERIES = {
    "op1_permutation_index": ann.op1_permutation_index,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_language_id": langid.op3_language_id,
    "op4_pii": pii.op4_pii,
    "op5_packing": packing.op5_packing,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_url_filters": urls.op7_url_filters,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_partenum_join": partenum.op9_partenum_join,
    "op10_quality": quality.op10_quality,
}

ORACLES: dict[str, str] = {
    "op6_decontamination": decontaminate.ORACLE,
    "op9_partenum_join": partenum.ORACLE,
}
