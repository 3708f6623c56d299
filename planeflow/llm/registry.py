"""The subpackage's queries and their SQL."""

from . import chat_format, exact_dedup, line_dedup, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, substring_dedup


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_pii": pii.op3_pii,
        "op4_mixing": mixing.op4_mixing,
        "op5_quality_classifier": quality_classifier.op5_quality_classifier,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_chat_format": chat_format.op8_chat_format,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.OP1_SQL,
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op6_quality_rules": quality_rules.OP6_SQL,
        "op8_chat_format": chat_format.OP8_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
    }
