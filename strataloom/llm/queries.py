"""The queries of this subpackage on the driver tables, and their SQL."""

from __future__ import annotations

from . import best_fit, chat, decontaminate, html_text, langid, packing, phrases, quality, sharding, simhash, spelling, token_files, toxicity


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            chat.op1_chat_formatting,
            quality.op2_quality_rules,
            packing.op3_packing,
            html_text.op4_html_extraction,
            token_files.op5_token_files,
            simhash.op6_simhash_near_dedup,
            langid.op7_language_id,
            decontaminate.op8_decontamination,
            sharding.op9_sharding,
            toxicity.op10_toxicity,
            spelling.op11_spelling_variants,
            best_fit.op12_best_fit_packing,
            phrases.op13_phrase_collocations,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {**chat.ORACLE_SQL, **decontaminate.ORACLE_SQL, **phrases.ORACLE_SQL, **spelling.ORACLE_SQL}
