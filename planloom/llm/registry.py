"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from planloom.llm import ann, mixing, quality_classifier, quality_rules, sentencepiece_codec, simhash, substring_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_simhash": simhash.query,
    "op3_sentencepiece": sentencepiece_codec.query,
    "op4_quality_rules": quality_rules.query,
    "op5_warc": warc.query,
    "op6_ann": ann.query,
    "op7_toxicity": toxicity.query,
    "op8_mixing": mixing.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_substring_dedup": substring_dedup.query,
}

#: Those that SQL can express.
SQL = {
    "op4_quality_rules": quality_rules.SQL,
    "op5_warc": warc.SQL,
    "op8_mixing": mixing.SQL,
}
