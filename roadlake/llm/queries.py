"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from roadlake.llm import decontaminate, packing, pivot_search, secret_scan, sharding, simhash, suffix_dedup, token_table, toxicity, warc


def queries() -> dict:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_secrets": secret_scan.op2_secrets,
        "op3_packing": packing.op3_packing,
        "op4_pivot_search": pivot_search.op4_pivot_search,
        "op5_simhash": simhash.op5_simhash,
        "op6_repeats": suffix_dedup.op6_repeats,
        "op7_warc": warc.op7_warc,
        "op8_token_table": token_table.op8_token_table,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_sharding": sharding.op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontaminate.OP1_SQL,
        "op4_pivot_search": pivot_search.OP4_SQL,
        "op6_repeats": suffix_dedup.OP6_SQL,
        "op7_warc": warc.OP7_SQL,
    }
