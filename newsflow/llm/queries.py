"""The queries of this subpackage; their results come from the operators."""

from __future__ import annotations

from newsflow.llm import (
    dart_minhash,
    decontamination,
    fill_middle,
    html_blocks,
    kneser_ney,
    periodic_runs,
    pieces,
    quality,
    sharding,
    substrings,
    token_files,
    toxicity,
    vptree,
)

QUERIES = {
    "op1_ordinal_toxicity": toxicity.query,
    "op2_repair_tokens": token_files.query,
    "op3_html_blocks": html_blocks.query,
    "op4_seed_extend": substrings.query,
    "op5_dart_minhash": dart_minhash.query,
    "op6_vp_tree": vptree.query,
    "op7_neighbour_quality": quality.query,
    "op8_piece_transducer": pieces.query,
    "op9_decontamination": decontamination.query,
    "op10_bounded_ring": sharding.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_kneser_ney": kneser_ney.query,
    "op13_fill_middle": fill_middle.query,
}
# The others are tested against brute force.
ORACLES: dict[str, str] = {
    "op4_seed_extend": substrings.SQL,
    "op12_kneser_ney": kneser_ney.SQL,
    "op13_fill_middle": fill_middle.SQL,
}
