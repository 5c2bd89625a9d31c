"""The queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from shelfspark.llm import (ann, byte_bpe, collocations, exact_dedup, harmonic, near_dedup, packing, periodic_runs, pii, quality,
                            repeated_spans, sharding, toxicity)

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_co_trained_quality": quality.query,
    "op2_prefix_sum_sharding": sharding.query,
    "op3_content_sort_dedup": exact_dedup.query,
    "op4_crf_personal_data": pii.query,
    "op5_run_length_index_dedup": repeated_spans.query,
    "op6_lexicon_toxicity": toxicity.query,
    "op7_hyperminhash_near_dedup": near_dedup.query,
    "op8_distinct_word_byte_bpe": byte_bpe.query,
    "op9_cross_polytope_neighbours": ann.query,
    "op10_sum_of_squares_packing": packing.query,
    "op11_harmonic_packing": harmonic.query,
    "op12_stripes_collocations": collocations.query,
    "op13_periodic_runs": periodic_runs.query,
}

ORACLES = {name: sql for name, sql in [("pipeline", corpus_pipeline.ORACLE_SQL)] if sql} | {
    "op3_content_sort_dedup": exact_dedup.ORACLE,
    "op12_stripes_collocations": collocations.ORACLE,
    "op13_periodic_runs": periodic_runs.ORACLE,
}
