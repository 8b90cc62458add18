"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import ann, exact_dedup, lexical, line_dedup, mixing, pieces, quality_model, quality_rules, secrets, simhash, token_shards, warc

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_token_shards": token_shards.query,
    "op3_warc": warc.query,
    "op4_simhash_near_dedup": simhash.query,
    "op5_quality_rules": quality_rules.query,
    "op6_sentencepiece": pieces.query,
    "op7_quality_classifier": quality_model.query,
    "op8_secret_scans": secrets.query,
    "op9_nearest_neighbours": ann.query,
    "op10_mixing": mixing.query,
    "op11_exact_dedup": exact_dedup.query,
    "op12_lexical_search": lexical.query,
}

ORACLES: dict[str, str] = {"op8_secret_scans": secrets.SQL, "op10_mixing": mixing.SQL, "op11_exact_dedup": exact_dedup.SQL, "op12_lexical_search": lexical.SQL}
