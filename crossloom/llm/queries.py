"""Queries of this subpackage, by name; ``ORACLE`` has the SQL of those that SQL can express."""

from __future__ import annotations

from crossloom.llm import audit, covertree, decontaminate, htmltext, langid, mixing, packing, periodic, quality, simhash, substring, toxicity, warc

QUERIES = {
    "op1_mix_to_target_weights": mixing.query,
    "op2_warc_zstandard": warc.query,
    "op3_toxicity_convolution": toxicity.query,
    "op4_html_text_density": htmltext.query,
    "op5_pack_sum_of_squares": packing.query,
    "op6_cover_tree_near_dedup": covertree.query,
    "op7_simhash_near_dedup": simhash.query,
    "op8_distribution_divergence": quality.query,
    "op9_language_by_compression": langid.query,
    "op10_substring_dedup": substring.query,
    "op11_filter_interactions": audit.query,
    "op12_benchmark_windows": decontaminate.query,
    "op13_periodic_runs": periodic.query,
}
ORACLE: dict[str, str] = {
    "op1_mix_to_target_weights": mixing.SQL,
    "op2_warc_zstandard": warc.SQL,
    "op6_cover_tree_near_dedup": covertree.SQL,
    "op10_substring_dedup": substring.SQL,
    "op11_filter_interactions": audit.SQL,
    "op12_benchmark_windows": decontaminate.SQL,
    "op13_periodic_runs": periodic.SQL,
}
