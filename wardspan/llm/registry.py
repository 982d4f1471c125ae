"""The queries of this package and their SQL twins."""

from __future__ import annotations

from . import bpe, digest, html_text, line_dedup, lm, mixing, neighbours, quality, secrets, simhash

QUERIES = {
    "op1_simhash_near_dedup": simhash.query,
    "op2_html_text": html_text.query,
    "op3_line_dedup": line_dedup.query,
    "op4_bpe": bpe.query,
    "op5_nn_descent": neighbours.query,
    "op6_quality_classifier": quality.query,
    "op7_lm_score": lm.query,
    "op8_secret_links": secrets.query,
    "op9_quartile_digest": digest.query,
    "op10_source_mixing": mixing.query,
    "secret_counts": secrets.counts,
    "digest_edited_texts": digest.edited_texts,
}

ORACLES = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
    "secret_counts": secrets.COUNTS,
    "digest_edited_texts": digest.EDITED,
}
