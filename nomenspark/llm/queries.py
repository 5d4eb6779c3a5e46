"""Queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from . import q01, q02, q03, q04, q05, q06, q07, q08, q09, q10


def queries() -> dict:
    return {
        "op1_bpe": q01.op1_bpe,
        "op2_token_counts": q02.op2_token_counts,
        "op3_quality_rules": q03.op3_quality_rules,
        "op4_token_files": q04.op4_token_files,
        "op5_mixing": q05.op5_mixing,
        "op6_near_vectors": q06.op6_near_vectors,
        "op7_lm_scores": q07.op7_lm_scores,
        "op8_substring_dedup": q08.op8_substring_dedup,
        "op9_minhash": q09.op9_minhash,
        "op10_secrets": q10.op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": q03.SQL, "op6_near_vectors": q06.SQL, "op7_lm_scores": q07.SQL}
