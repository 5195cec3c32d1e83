"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from cadence.llm import (
    bpe,
    chat,
    conversation_trie,
    decontaminate,
    exact_dedup,
    jaccard,
    lexical_search,
    packing,
    quality_classifier,
    quality_rules,
    secrets,
    suffix_dedup,
    warc,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_packing": packing.op2_packing,
    "op3_warc": warc.op3_warc,
    "op4_secret_scans": secrets.op4_secret_scans,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_bpe": bpe.op8_bpe,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_decontamination": decontaminate.op11_decontamination,
    "op12_conversation_trie": conversation_trie.op12_conversation_trie,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

#: The others are tested against brute-force versions in tests/llm.
ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op3_warc": warc.OP3_SQL,
    "op11_decontamination": decontaminate.OP11_SQL,
    "op12_conversation_trie": conversation_trie.OP12_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
