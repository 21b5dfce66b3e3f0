"""Queries of the training-data operators and the SQL that gives the same rows, by name."""

from tessera.llm import chat_format, conversation_repair, decontaminate, flac, lattice_lm, license_scan, packing, quality, secrets_scan, simhash, spelling, suffix_dedup, url_filters

QUERIES = {
    "op1_lattice_lm": lattice_lm.op1_lattice_lm,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_simhash": simhash.op4_simhash,
    "op5_secrets": secrets_scan.op5_secrets,
    "op6_flac": flac.op6_flac,
    "op7_quality": quality.op7_quality,
    "op8_packing": packing.op8_packing,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_licenses": license_scan.op10_licenses,
    "op11_url_filters": url_filters.op11_url_filters,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op11_url_filters": url_filters.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
