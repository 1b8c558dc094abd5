"""The subpackage's queries and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .decontaminate import op3_benchmark_decontamination
from .language_id import op7_language_id
from .near_dup import op5_minhash_near_dedup
from .packing import op4_best_fit_packing
from .quality_lm import op10_quality_classifier
from .quotations import op1_quotation_linking
from .token_ids import op6_token_ids
from .toxicity import op2_toxicity
from .url_filter import OP9_SQL, op9_url_filter
from .vector_join import op8_embedding_near_dedup

_OPS = [op1_quotation_linking, op2_toxicity, op3_benchmark_decontamination, op4_best_fit_packing, op5_minhash_near_dedup, op6_token_ids, op7_language_id, op8_embedding_near_dedup, op9_url_filter, op10_quality_classifier]

QUERIES = {f.__name__: f for f in _OPS} | {"pipeline": corpus_pipeline.run}
SQL = {"op9_url_filter": OP9_SQL}
