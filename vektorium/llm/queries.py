"""Queries and SQL of this subpackage."""

from . import bpe, cross_polytope, exact_dedup, langid, license_scan, line_dedup, lm_score, mixing, simhash, substring_dedup

_ALL = {
    "op1_lm_score": lm_score,
    "op2_cross_polytope": cross_polytope,
    "op3_mixing": mixing,
    "op4_line_dedup": line_dedup,
    "op5_bpe": bpe,
    "op6_simhash": simhash,
    "op7_license_scan": license_scan,
    "op8_substring_dedup": substring_dedup,
    "op9_exact_dedup": exact_dedup,
    "op10_language_id": langid,
}


def queries() -> dict:
    return {name: m.query for name, m in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in _ALL.items() if m.SQL}
