"""The queries of this subpackage and, where SQL can express one, its SQL."""

from folioflow.llm import conversations, decontamination, jaccard, language_model, line_dedup, packing, phrases, privacy, quality, secrets, sharding, topk, warc

QUERIES = {
    "op1_exact_top_k": topk.op1_exact_top_k,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op4_lm_scoring": language_model.op4_lm_scoring,
    "op5_packing": packing.op5_packing,
    "op6_pii_sanitisation": privacy.op6_pii_sanitisation,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_warc_revisits": warc.op8_warc_revisits,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_sharding": sharding.op11_sharding,
    "op12_phrase_collocations": phrases.op12_phrase_collocations,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}
ORACLE: dict[str, str] = {
    "op1_exact_top_k": topk.SQL,
    "op2_decontamination": decontamination.SQL,
    "op3_ngram_jaccard_join": jaccard.SQL,
    "op8_warc_revisits": warc.SQL,
    "op11_sharding": sharding.SQL,
    "op12_phrase_collocations": phrases.SQL,
    "op13_conversation_repair": conversations.SQL,
}
