"""Queries and oracles of the training-data operators."""

from __future__ import annotations

import functools

from strata.llm import exact_dedup, html_text, lm_score, merkle_audit, ngram_join, packing, piece_codec, quality_rules, repeat_index, url_filter
from strata.llm.common import ready


def _query(run):
    @functools.wraps(run)
    def query(spark, sf_dir):
        ready(spark)
        return run(spark, sf_dir)

    return query


QUERIES = {
    run.__name__: _query(run)
    for run in (
        repeat_index.op1_suffix_dedup,
        ngram_join.op2_ngram_join,
        merkle_audit.op3_merkle_audit,
        url_filter.op4_url_filter,
        html_text.op5_html_text,
        piece_codec.op6_piece_codec,
        exact_dedup.op7_exact_dedup,
        packing.op8_best_fit_packing,
        lm_score.op9_lm_score,
        quality_rules.op10_quality_rules,
    )
}
#: the others are tested against brute force
ORACLES = {
    "op3_merkle_audit": merkle_audit.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
}
