"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import archives, extraction, minhash, mixing, packing, quality, suffixes, toxicity, urls, vectors

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_vector_links": vectors.op3_vector_links,
    "op4_warc_packages": archives.op4_warc_packages,
    "op5_html_text": extraction.op5_html_text,
    "op6_url_filter": urls.op6_url_filter,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_pack_documents": packing.op9_pack_documents,
    "op10_probminhash": minhash.op10_probminhash,
}
#: On larger tables those of op3, op7 and op10 take long: they look at all pairs of a label, all windows, all pairs with a shingle.
ORACLE_SQL = {
    "op1_mix_sources": mixing.SQL,
    "op3_vector_links": vectors.SQL,
    "op4_warc_packages": archives.SQL,
    "op6_url_filter": urls.SQL,
    "op7_suffix_dedup": suffixes.SQL,
    "op10_probminhash": minhash.SQL,
}
