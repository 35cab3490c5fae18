"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slotwise.llm.ann import op4_ann
from slotwise.llm.bpe import op1_bpe
from slotwise.llm.chat import OP2_SQL, op2_chat
from slotwise.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from slotwise.llm.lm_score import op6_lm_score
from slotwise.llm.mixing import op5_mixing
from slotwise.llm.sharding import op9_sharding
from slotwise.llm.simhash import op10_simhash
from slotwise.llm.suffix_dedup import op3_suffix_dedup
from slotwise.llm.toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_chat": op2_chat,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ann": op4_ann,
    "op5_mixing": op5_mixing,
    "op6_lm_score": op6_lm_score,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {"op2_chat": OP2_SQL, "op7_exact_dedup": OP7_SQL}
