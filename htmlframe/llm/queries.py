"""Queries of this subpackage for __spark_entry__.py."""

from htmlframe.llm import ann, bpe, chat, codes, fingerprint, html_extract, linededup, packing, quality, runs, simhash, toxicity, treebpe

QUERIES = {
    "op1_byte_bpe": bpe.query,
    "op2_neighbours": ann.query,
    "op3_simhash": simhash.query,
    "op4_chat": chat.query,
    "op5_main_text": html_extract.query,
    "op6_quality": quality.query,
    "op7_fingerprints": fingerprint.query,
    "op8_packing": packing.query,
    "op9_toxicity": toxicity.query,
    "op10_line_dedup": linededup.query,
    "op11_vector_codes": codes.query,
    "op12_periodic_runs": runs.query,
    "op13_tree_bpe": treebpe.query,
}
ORACLES = {"op4_chat": chat.ORACLE, "op5_main_text": html_extract.ORACLE, "op11_vector_codes": codes.ORACLE}
