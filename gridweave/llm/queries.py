"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import context_tree, decontaminate, histogram_sort, licences, merkle, mixing, prefix_rollup, prefix_tree_join, quality, toxicity, turn_repair, url_filter, warc

QUERIES = {
    "op1_licence_scan": licences.op1_licence_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality_cotraining": quality.op3_quality_cotraining,
    "op4_warc": warc.op4_warc,
    "op5_ngram_jaccard_join": prefix_tree_join.op5_ngram_jaccard_join,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_merkle_fingerprint": merkle.op9_merkle_fingerprint,
    "op10_context_tree": context_tree.op10_context_tree,
    "op11_histogram_sort": histogram_sort.op11_histogram_sort,
    "op12_prefix_rollup": prefix_rollup.op12_prefix_rollup,
    "op13_turn_repair": turn_repair.op13_turn_repair,
}

#: Learned scores (op2, op3, op10) have no SQL: tests hold them against held-out labels or a brute-force version.
ORACLES = {
    "op1_licence_scan": licences.OP1_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_ngram_jaccard_join": prefix_tree_join.OP5_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op7_benchmark_decontamination": decontaminate.OP7_SQL,
    "op8_source_mixing": mixing.OP8_SQL,
    "op9_merkle_fingerprint": merkle.OP9_SQL,
    "op11_histogram_sort": histogram_sort.OP11_SQL,
    "op12_prefix_rollup": prefix_rollup.OP12_SQL,
    "op13_turn_repair": turn_repair.OP13_SQL,
}
