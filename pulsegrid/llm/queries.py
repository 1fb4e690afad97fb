"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from pulsegrid.llm import binary, bpe, decontaminate, fim, html, lines, minhash, mixing, quality, runs, secrets, suffixes, urls


def queries() -> dict:
    return {
        "op1_html_extraction": html.html_query,
        "op2_decontamination": decontaminate.leaks_query,
        "op3_byte_bpe": bpe.bpe_query,
        "op4_quality_rules": quality.quality_query,
        "op5_minhash_near_dedup": minhash.near_query,
        "op6_token_files": binary.tokens_query,
        "op7_suffix_array_dedup": suffixes.repeats_query,
        "op8_secret_scan": secrets.secrets_query,
        "op9_url_filter": urls.urls_query,
        "op10_line_dedup": lines.lines_query,
        "op11_periodic_runs": runs.runs_query,
        "op12_source_mixing": mixing.mixing_query,
        "op13_fill_in_middle": fim.fim_query,
    }


def oracle_sql() -> dict:
    return {"op4_quality_rules": quality.ORACLE, "op5_minhash_near_dedup": minhash.ORACLE, "op9_url_filter": urls.ORACLE, "op13_fill_in_middle": fim.ORACLE}
