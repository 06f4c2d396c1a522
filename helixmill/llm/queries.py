"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from helixmill.llm import decontaminate, fill_in_middle, language, near_dedup, packing, pii, sharding, token_alignment, token_counts, token_files, topk, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        near_dedup.op1_near_dedup,
        decontaminate.op2_decontamination,
        language.op3_language,
        token_counts.op4_token_counts,
        packing.op5_packing,
        sharding.op6_sharding,
        warc.op7_warc,
        pii.op8_pii,
        toxicity.op9_toxicity,
        topk.op10_topk,
        token_files.op11_token_files,
        fill_in_middle.op12_fill_in_middle,
        token_alignment.op13_alignment,
    )
}
ORACLES = {"op2_decontamination": decontaminate.ORACLE, "op10_topk": topk.ORACLE, "op12_fill_in_middle": fill_in_middle.ORACLE}
