"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from graphloom.llm import bpe, centroids, codes, decontam, htmltext, langid, ngram_join, pii, secrets, substring, topk, toxicity, urls

QUERIES = {
    "op1_byte_bpe": bpe.op1_bpe,
    "op2_pii": pii.op2_pii,
    "op3_exact_topk": topk.op3_topk,
    "op4_language_id": langid.op4_langid,
    "op5_benchmark_decontamination": decontam.op5_decontaminate,
    "op6_secret_scans": secrets.op6_secrets,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_url_filters": urls.op8_urls,
    "op9_substring_dedup": substring.op9_substring,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_join,
    "op11_centroid_clustering": centroids.op11_centroids,
    "op12_html_extraction": htmltext.op12_html,
    "op13_vector_codes": codes.op13_codes,
    "secret_ledger_history": secrets.blob_history,
}

ORACLE_SQL = {
    "op3_exact_topk": topk.OP3_SQL,
    "op5_benchmark_decontamination": decontam.OP5_SQL,
    "op9_substring_dedup": substring.OP9_SQL,
    "op10_ngram_jaccard_join": ngram_join.OP10_SQL,
    "op11_centroid_clustering": centroids.OP11_SQL,
    "op12_html_extraction": htmltext.OP12_SQL,
    "op13_vector_codes": codes.OP13_SQL,
    "secret_ledger_history": secrets.BLOB_HISTORY_SQL,
}
