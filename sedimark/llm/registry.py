"""Queries of this subpackage and, where SQL can express them, the SQL that gives the same rows."""

from sedimark.llm import backoff_lm, byte_cnn, centroid_langid, cuckoo_dedup, host_rules, line_dedup, media_columns, ngram_join, packing, spelling_variants, trie_bpe, warc_merge, whitening

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_exact_dedup": cuckoo_dedup.op2_exact_dedup,
    "op3_trie_bpe": trie_bpe.op3_trie_bpe,
    "op4_media_columns": media_columns.op4_media_columns,
    "op5_warc_merge": warc_merge.op5_warc_merge,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_backoff_lm": backoff_lm.op7_backoff_lm,
    "op8_byte_cnn": byte_cnn.op8_byte_cnn,
    "op9_centroid_langid": centroid_langid.op9_centroid_langid,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_host_rules": host_rules.op12_host_rules,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op2_exact_dedup": cuckoo_dedup.ORACLE,
    "op5_warc_merge": warc_merge.ORACLE,
    "op6_ngram_join": ngram_join.ORACLE,
    "op7_backoff_lm": backoff_lm.ORACLE,
    "op11_spelling_variants": spelling_variants.ORACLE,
    "op12_host_rules": host_rules.ORACLE,
}
