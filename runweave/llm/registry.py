"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runweave.llm import oracle
from runweave.llm.ann import op5_nearest_neighbours
from runweave.llm.chat import op4_chat_format
from runweave.llm.fingerprints import op1_fingerprint
from runweave.llm.jaccard import op9_ngram_jaccard_join
from runweave.llm.langid import op2_language_id
from runweave.llm.lmscore import op3_lm_score
from runweave.llm.mixing import op10_mix_sources
from runweave.llm.packing import op6_pack
from runweave.llm.secrets import op8_secret_scan
from runweave.llm.substrings import op7_substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_language_id": op2_language_id,
    "op3_lm_score": op3_lm_score,
    "op4_chat_format": op4_chat_format,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_pack": op6_pack,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_mix_sources": op10_mix_sources,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat_format": oracle.OP4,
    "op7_substring_dedup": oracle.OP7,
    "op9_ngram_jaccard_join": oracle.OP9,
}
