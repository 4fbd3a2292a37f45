"""Queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, exact_dedup, fill_middle, jaccard, lexical, mixing, packing, secrets, suffix_dedup, token_files, token_rollup, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_secrets": secrets.op3_secrets,
    "op4_bpe": bpe.op4_bpe,
    "op5_token_files": token_files.op5_token_files,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_ann": ann.op7_ann,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_rollup": token_rollup.op9_token_rollup,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_packing": packing.op12_packing,
    "op13_lexical": lexical.op13_lexical,
}

SQL = {
    "op2_mixing": mixing.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op11_fill_middle": fill_middle.SQL,
    "op13_lexical": lexical.SQL,
}
