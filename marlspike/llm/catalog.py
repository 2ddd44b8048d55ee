"""Queries over the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, bpe, decontaminate, digest, htmlmain, merkle, mixing, quality, simhash, suffixes, tokencounts, toxicity, warc

QUERIES = {
    "op1_digest": digest.op1,
    "op2_toxicity": toxicity.op2,
    "op3_mix_sources": mixing.op3,
    "op4_extract_html": htmlmain.op4,
    "op5_quality": quality.op5,
    "op6_warc_derivatives": warc.op6,
    "op7_suffix_dedup": suffixes.op7,
    "op8_decontaminate": decontaminate.op8,
    "op9_simhash_dedup": simhash.op9,
    "op10_token_rollups": tokencounts.op10,
    "op11_token_alignment": alignment.op11,
    "op12_merkle_manifest": merkle.op12,
    "op13_bpe_codec": bpe.op13,
}

ORACLES = {
    "op7_suffix_dedup": suffixes.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op10_token_rollups": tokencounts.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
