"""The registered queries of the corpus operators."""

from __future__ import annotations

import corpus_pipeline
from framelake.llm import cotraining, decontaminate, exact_dedup, jaccard_join, mixing, pii, sentence_spans, suffix_dedup, token_records, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_quality": cotraining.op7_quality,
    "op8_sentence_spans": sentence_spans.op8_sentence_spans,
    "op9_pii": pii.op9_pii,
    "op10_token_output": token_records.op10_token_output,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
}
