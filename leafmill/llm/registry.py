"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from leafmill.llm import decontaminate, divergence, embeddings, jaccard, language, lines, mixing, sharding, spelling, substring, suffix_family, tokens, toxicity


def queries():
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_ngram_jaccard_join": jaccard.op2_ngram_jaccard_join,
        "op3_embedding_near_dedup": embeddings.op3_embedding_near_dedup,
        "op4_substring_dedup": substring.op4_substring_dedup,
        "op5_sharding": sharding.op5_sharding,
        "op6_mixing": mixing.op6_mixing,
        "op7_token_counts": tokens.op7_token_counts,
        "op8_language_id": language.op8_language_id,
        "op9_suffix_array_dedup": suffix_family.op9_suffix_array_dedup,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_line_dedup": lines.op13_line_dedup,
    }


def oracle_sql():
    return {
        "op1_decontamination": decontaminate.OP1_SQL,
        "op2_ngram_jaccard_join": jaccard.OP2_SQL,
        "op3_embedding_near_dedup": embeddings.OP3_SQL,
        "op4_substring_dedup": substring.OP4_SQL,
        "op5_sharding": sharding.OP5_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op9_suffix_array_dedup": suffix_family.OP9_SQL,
        "op11_spelling_variants": spelling.OP11_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
        "op13_line_dedup": lines.OP13_SQL,
    }
