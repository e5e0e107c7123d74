"""The queries of this subpackage, by name, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.chat import OP5_SQL, op5_chat_formatting
from brindle.llm.debruijn import OP10_SQL, op10_debruijn_substring_dedup
from brindle.llm.decontamination import op1_spaced_seed_decontamination
from brindle.llm.embeddings import OP3_SQL, op3_embedding_near_duplicates
from brindle.llm.packing import op7_best_fit_packing
from brindle.llm.quality import op9_passage_attention_quality
from brindle.llm.sharding import op6_balanced_sharding
from brindle.llm.simhash import op8_simhash_near_duplicates
from brindle.llm.suffixes import OP2_SQL, op2_suffix_array_dedup
from brindle.llm.toxicity import op4_subword_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spaced_seed_decontamination": op1_spaced_seed_decontamination,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_embedding_near_duplicates": op3_embedding_near_duplicates,
    "op4_subword_toxicity": op4_subword_toxicity,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_balanced_sharding": op6_balanced_sharding,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_simhash_near_duplicates": op8_simhash_near_duplicates,
    "op9_passage_attention_quality": op9_passage_attention_quality,
    "op10_debruijn_substring_dedup": op10_debruijn_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_array_dedup": OP2_SQL,
    "op3_embedding_near_duplicates": OP3_SQL,
    "op5_chat_formatting": OP5_SQL,
    "op10_debruijn_substring_dedup": OP10_SQL,
}
