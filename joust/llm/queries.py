"""The subpackage's queries and the SQL that some of them are compared with."""

from __future__ import annotations

from . import chat, codes, decontam, html, mixing, neighbours, ngrams, order, quality, resample, simhash, suffixes, urls

QUERIES = {
    "op1_training_order": order.op1_training_order,
    "op2_line_field": quality.op2_line_field,
    "op3_url_boosting": urls.op3_url_boosting,
    "op4_multi_index": neighbours.op4_multi_index,
    "op5_suffix_intervals": suffixes.op5_suffix_intervals,
    "op6_systematic_mixing": mixing.op6_systematic_mixing,
    "op7_template_classes": html.op7_template_classes,
    "op8_chat_round_trip": chat.op8_chat_round_trip,
    "op9_simhash_variants": simhash.op9_simhash_variants,
    "op10_template_windows": decontam.op10_template_windows,
    "op11_prefix_tree": ngrams.op11_prefix_tree,
    "op12_sorted_counts": resample.op12_sorted_counts,
    "op13_segment_mean_codes": codes.op13_segment_mean_codes,
}

ORACLE_SQL = {
    "op6_systematic_mixing": mixing.ORACLE,
    "op8_chat_round_trip": chat.ORACLE,
    "op11_prefix_tree": ngrams.ORACLE,
    "op12_sorted_counts": resample.ORACLE,
    "op13_segment_mean_codes": codes.oracle(),
}
