"""The queries of this subpackage and the SQL that some of them can be checked with."""

from __future__ import annotations

from . import exact, html, jaccard, mixing, pieces, pii, quality, substring, suffix, toxicity

QUERIES = {
    "op1_quality": quality.query,
    "op2_substring": substring.query,
    "op3_pii": pii.query,
    "op4_html": html.query,
    "op5_toxicity": toxicity.query,
    "op6_exact": exact.query,
    "op7_pieces": pieces.query,
    "op8_mixing": mixing.query,
    "op9_jaccard": jaccard.query,
    "op10_suffix": suffix.query,
}

ORACLES = {"op1_quality": quality.oracle, "op2_substring": substring.oracle, "op6_exact": exact.oracle, "op10_suffix": suffix.oracle}


def queries() -> dict:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: text() for name, text in ORACLES.items()}
