"""The queries of this subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

import corpus_pipeline
from tramline.llm import byte_bpe, decontamination, embedding_join, line_dedup, pii, quality, simhash, site_style_tree, token_store, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_embedding_join": embedding_join.op4_embedding_join,
    "op5_token_store": token_store.op5_token_store,
    "op6_quality": quality.op6_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_pii": pii.op8_pii,
    "op9_site_style_tree": site_style_tree.op9_site_style_tree,
    "op10_decontamination": decontamination.op10_decontamination,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op10_decontamination": decontamination.OP10_SQL,
}
