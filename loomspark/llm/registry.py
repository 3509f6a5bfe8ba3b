"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from loomspark.llm import chat, credentials, extraction, licenses, lines, middle, minhash, neighbours, packing, phrases, quality, substring, winnow

QUERIES = {
    "op1_secret_scans": credentials.op1_secret_scans,
    "op2_minhash_neardup": minhash.op2_minhash_neardup,
    "op3_license_scans": licenses.op3_license_scans,
    "op4_nearest_neighbours": neighbours.op4_nearest_neighbours,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_benchmark_decontamination": winnow.op6_benchmark_decontamination,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_html_extraction": extraction.op8_html_extraction,
    "op9_substring_dedup": substring.op9_substring_dedup,
    "op10_packing": packing.op10_packing,
    "op11_chat_formatting": chat.op11_chat_formatting,
    "op12_phrase_mining": phrases.op12_phrase_mining,
    "op13_fill_in_middle": middle.op13_fill_in_middle,
}
ORACLE_SQL = {
    "op2_minhash_neardup": minhash.ORACLE,
    "op3_license_scans": licenses.ORACLE,
    "op6_benchmark_decontamination": winnow.ORACLE,
    "op8_html_extraction": extraction.ORACLE,
    "op9_substring_dedup": substring.ORACLE,
    "op11_chat_formatting": chat.ORACLE,
    "op12_phrase_mining": phrases.ORACLE,
    "op13_fill_in_middle": middle.ORACLE,
}
