"""The registered corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from tessella.llm.decontamination import op9_benchmark_decontamination
from tessella.llm.language_id import op10_language_id
from tessella.llm.line_dedup import OP1_SQL, op1_line_dedup
from tessella.llm.lm_score import op8_lm_scoring
from tessella.llm.ngram_join import op6_ngram_jaccard_join
from tessella.llm.packing import op3_best_fit_packing
from tessella.llm.quality import op4_quality_rules
from tessella.llm.sharding import OP5_SQL, op5_sharding
from tessella.llm.suffix_dedup import op7_suffix_array_dedup
from tessella.llm.token_counts import op2_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_best_fit_packing, op4_quality_rules, op5_sharding, op6_ngram_jaccard_join, op7_suffix_array_dedup, op8_lm_scoring, op9_benchmark_decontamination, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op5_sharding": OP5_SQL}
