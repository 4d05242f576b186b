"""The registered queries of this subpackage and their SQL."""

from . import bpe, conversation_repair, decontamination, embedding_dedup, fingerprints, hard_negatives, html_text, near_dedup, quality, secret_scan, sharding, substring_dedup, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_html_extraction": html_text.op4_html_extraction,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_warc": warc.op7_warc,
    "op8_bpe": bpe.op8_bpe,
    "op9_sharding": sharding.op9_sharding,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_document_fingerprints": fingerprints.op11_document_fingerprints,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
SQL = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op2_near_dedup": near_dedup.OP2_SQL,
    "op4_html_extraction": html_text.OP4_SQL,
    "op5_embedding_dedup": embedding_dedup.OP5_SQL,
    "op6_secret_scan": secret_scan.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_sharding": sharding.op9_sql(),
    "op11_document_fingerprints": fingerprints.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_conversation_repair": conversation_repair.OP13_SQL,
}
