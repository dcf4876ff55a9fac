"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from lodestone.llm import alignment, extraction, gif, langid, mixing, neardup, packing, periods, pieces, pii, quality, sharding, suffixes

QUERIES = {
    "op1_distinct_chunks": pieces.op1_distinct_chunks,
    "op3_quality_cascade": quality.op3_quality_cascade,
    "op2_weighted_minhash": neardup.op2_weighted_minhash,
    "op4_gif_frames": gif.op4_gif_frames,
    "op5_suffix_array": suffixes.op5_suffix_array,
    "op6_grouping_genetic": packing.op6_grouping_genetic,
    "op7_two_pass_shuffle": sharding.op7_two_pass_shuffle,
    "op8_min_cut": extraction.op8_min_cut,
    "op9_pii_spans": pii.op9_pii_spans,
    "op10_subword_softmax": langid.op10_subword_softmax,
    "op11_elementary_intervals": alignment.op11_elementary_intervals,
    "op12_prefix_sums": mixing.op12_prefix_sums,
    "op13_all_lags": periods.op13_all_lags,
}

ORACLE_SQL = {
    "op3_quality_cascade": quality.OP3_SQL,
    "op9_pii_spans": pii.OP9_SQL,
    "op12_prefix_sums": mixing.OP12_SQL,
}
