"""Registered queries of this subpackage; ``ORACLE_SQL`` holds those that DuckDB can express."""

import corpus_pipeline
from touchline.llm import filter_audit
from touchline.llm.block_dedup import op11_block_dedup
from touchline.llm.decontamination import op2_decontamination
from touchline.llm.filter_audit import op12_filter_audit
from touchline.llm.html_extract import op8_html_extract
from touchline.llm.lm_scoring import op1_lm_scoring
from touchline.llm.packing import op5_packing
from touchline.llm.prefix_trie import op13_prefix_trie
from touchline.llm.quality_classifier import op3_quality_classifier
from touchline.llm.quality_rules import op7_quality_rules
from touchline.llm.simhash_dedup import op10_simhash_dedup
from touchline.llm.suffix_dedup import op4_suffix_dedup
from touchline.llm.token_counts import op9_token_counts
from touchline.llm.toxicity import op6_toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_lm_scoring": op1_lm_scoring,
    "op2_decontamination": op2_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_extract": op8_html_extract,
    "op9_token_counts": op9_token_counts,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_block_dedup": op11_block_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {"op12_filter_audit": filter_audit.ORACLE_SQL}
ORACLE_SQL |= {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
