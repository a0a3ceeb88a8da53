"""The queries of this subpackage, and their SQL where SQL can express them."""

from . import counting, digest, exact, language, mincut, mixing, neardup, replay, suffix, warc

QUERIES = {
    "op1_suffix_dedup": suffix.query,
    "op2_exact_dedup": exact.query,
    "op3_language_id": language.query,
    "op4_html_extraction": mincut.query,
    "op5_source_mixing": mixing.query,
    "op6_fingerprints": digest.query,
    "op7_near_dedup": neardup.query,
    "op8_byte_bpe": replay.query,
    "op9_token_counts": counting.query,
    "op10_warc_bundles": warc.query,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact.ORACLE,
    "op5_source_mixing": mixing.ORACLE,
    "op10_warc_bundles": warc.ORACLE,
}
