"""The queries of this package, by name, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import filter_audit, jaccard, language, licenses, line_dedup, mixing, pieces, quality, resampling, sharding, suffixes, topk, urls

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_licenses": licenses.op2_licenses,
    "op3_language": language.op3_language,
    "op4_urls": urls.op4_urls,
    "op5_topk": topk.op5_topk,
    "op6_pieces": pieces.op6_pieces,
    "op7_mixing": mixing.op7_mixing,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_suffixes": suffixes.op9_suffixes,
    "op10_sharding": sharding.op10_sharding,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_resampling": resampling.op12_resampling,
    "op13_line_dedup": line_dedup.op13_line_dedup,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_quality": quality.OP1_SQL,
    "op2_licenses": licenses.OP2_SQL,
    "op5_topk": topk.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_jaccard": jaccard.OP8_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_resampling": resampling.OP12_SQL,
    "op13_line_dedup": line_dedup.OP13_SQL,
}
