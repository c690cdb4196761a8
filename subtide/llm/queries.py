"""The training-data queries and their SQL."""

from subtide.llm import chat, collocations, imatch, matroska, merkle, mixing, ngram_join, packing, quality, secrets, suffix_dedup, superminhash, url_filters

QUERIES = {
    "op1_matroska": matroska.op1_matroska,
    "op2_chat": chat.op2_chat,
    "op3_mixing": mixing.op3_mixing,
    "op4_secrets": secrets.op4_secrets,
    "op5_url_filters": url_filters.op5_url_filters,
    "op6_imatch": imatch.op6_imatch,
    "op7_quality": quality.op7_quality,
    "op8_packing": packing.op8_packing,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_merkle": merkle.op11_merkle,
    "op12_superminhash": superminhash.op12_superminhash,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL = {
    "op3_mixing": mixing.ORACLE,
    "op5_url_filters": url_filters.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op12_superminhash": superminhash.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
