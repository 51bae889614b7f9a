"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from llm import collocations, decontaminate, html_extract, infilling, mixing, ngram_join, pieces, quality_rules, suffix_dedup, token_counts, toxicity, url_filter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_mixing": mixing.op5_mixing,
    "op6_html_extraction": html_extract.op6_html_extraction,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_fill_in_middle": infilling.op12_fill_in_middle,
    "op13_collocations": collocations.op13_collocations,
}

SQL = {
    "op5_mixing": mixing.sql(),
    "op9_quality_rules": quality_rules.sql(),
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_fill_in_middle": infilling.sql(),
    "op13_collocations": collocations.sql(),
}
