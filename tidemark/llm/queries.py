"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from tidemark.llm.decontamination import op6_benchmark_decontamination
from tidemark.llm.html_extraction import op10_html_extraction
from tidemark.llm.jaccard_join import OP2_SQL, op2_ngram_jaccard_join
from tidemark.llm.license_scan import op3_license_scan, op3_sql
from tidemark.llm.quality_rules import op4_quality_rules, op4_sql
from tidemark.llm.sentencepiece_bpe import op9_sentencepiece
from tidemark.llm.sharding import op8_sharding
from tidemark.llm.suffix_dedup import OP7_SQL, op7_suffix_array_dedup
from tidemark.llm.toxicity import op5_toxicity
from tidemark.llm.url_filters import op1_url_filters

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_license_scan": op3_license_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_sharding": op8_sharding,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_html_extraction": op10_html_extraction,
}

ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard_join": OP2_SQL, "op3_license_scan": op3_sql(), "op4_quality_rules": op4_sql(), "op7_suffix_array_dedup": OP7_SQL}
