"""The queries of this subpackage and the SQL that states their results, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lecturelake.llm import chat, decontaminate, exact_dedup, minhash, near_join, oracles, pieces, prefix_trie, quality, sharding, spelling, substring_dedup, suffix_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_exact_dedup": exact_dedup.query,
    "op1_ngram_join": near_join.query,
    "op2_substring_dedup": substring_dedup.query,
    "op4_url_filters": url_filter.query,
    "op5_sharding": sharding.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_pieces": pieces.query,
    "op8_quality": quality.query,
    "op9_decontamination": decontaminate.query,
    "op10_chat": chat.query,
    "op11_spelling_variants": spelling.query,
    "op12_minhash": minhash.query,
    "op13_prefix_trie": prefix_trie.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op1_ngram_join": oracles.NGRAM_JOIN,
    "op2_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op4_url_filters": oracles.url_filters(url_filter.RULES, url_filter.UrlParams.damping, url_filter.UrlParams.factor, url_filter.UrlParams.floor),
    "op5_sharding": oracles.SHARDING,
    "op6_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op9_decontamination": oracles.DECONTAMINATION,
    "op11_spelling_variants": oracles.SPELLING,
    "op12_minhash": oracles.MIN_HASH,
    "op13_prefix_trie": oracles.PREFIX_TRIE,
}
