"""The queries of this package and their SQL."""

from __future__ import annotations

from tessera.llm import bpe, decontaminate, divergence, fim, fingerprints, language_id, ngram_join, sharding, suffix_dedup, token_counts, toxicity, url_filters, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_sharding": sharding.op5_sharding,
    "op6_bpe": bpe.op6_bpe,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_language_id": language_id.op10_language_id,
    "op11_warc": warc.op11_warc,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_divergence_audit": divergence.op13_divergence_audit,
}

SQL = {"op3_url_filters": url_filters.SQL, "op11_warc": warc.SQL, "op12_fill_in_middle": fim.SQL, "op13_divergence_audit": divergence.SQL}
