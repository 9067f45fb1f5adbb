"""Queries and SQL of this subpackage, for __spark_entry__.py."""

from ferrule.llm import ann_mih, divergence, html_diff, langid, line_dedup, minmax, packing, piece_bpe, simhash, topk_exact, toxicity, warc, whitening

QUERIES = {
    "op1_mih_neighbours": ann_mih.op1_mih_neighbours,
    "op2_legacy_warc": warc.op2_legacy_warc,
    "op3_language_mixture": langid.op3_language_mixture,
    "op4_piece_bpe": piece_bpe.op4_piece_bpe,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_subword_toxicity": toxicity.op7_subword_toxicity,
    "op8_kk_packing": packing.op8_kk_packing,
    "op9_nearest_url_text": html_diff.op9_nearest_url_text,
    "op10_segment_top_k": topk_exact.op10_segment_top_k,
    "op11_lanczos_whitening": whitening.op11_lanczos_whitening,
    "op12_minmax_near_dedup": minmax.op12_minmax_near_dedup,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLE_SQL = {"op2_legacy_warc": warc.SQL, "op5_line_dedup": line_dedup.SQL, "op10_segment_top_k": topk_exact.SQL, "op12_minmax_near_dedup": minmax.SQL, "op13_source_divergence": divergence.SQL}
