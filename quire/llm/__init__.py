"""Operators for training-data pipelines, and their queries.

Nothing else in the library imports this subpackage.
"""

from __future__ import annotations


def queries() -> dict:
    from . import bpe, decontaminate, html_extract, jaccard_join, language_id, quality, secrets, sharding, suffix_dedup, url_filter

    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_quality": quality.op2_quality,
        "op3_sharding": sharding.op3_sharding,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_bpe": bpe.op7_bpe,
        "op8_secrets": secrets.op8_secrets,
        "op9_html_extract": html_extract.op9_html_extract,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    from . import decontaminate, quality, secrets, sharding

    return {
        "op4_decontaminate": decontaminate.OP4_SQL,
       "op2_quality": quality.OP2_SQL, "op3_sharding": sharding.OP3_SQL, "op8_secrets": secrets.OP8_SQL}
