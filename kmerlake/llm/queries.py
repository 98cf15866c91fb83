"""The subpackage's queries and their SQL."""

from __future__ import annotations

from kmerlake.llm.bytebpe import op13_byte_bpe
from kmerlake.llm.decontaminate import OP4_SQL, op4_benchmark_decontamination
from kmerlake.llm.langid import op1_language_id
from kmerlake.llm.linededup import OP9_SQL, op9_line_dedup
from kmerlake.llm.mixing import OP6_SQL, op6_source_mixing
from kmerlake.llm.periodic import op12_periodic_runs
from kmerlake.llm.quality import op7_quality_classifier
from kmerlake.llm.simhash import op3_simhash_near_dedup
from kmerlake.llm.spotsigs import OP5_SQL, op5_document_fingerprints
from kmerlake.llm.suffixdedup import op10_suffix_dedup
from kmerlake.llm.tokencount import op2_token_counts
from kmerlake.llm.tokenfiles import op8_token_id_output
from kmerlake.llm.whitening import op11_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_token_counts,
        op3_simhash_near_dedup,
        op4_benchmark_decontamination,
        op5_document_fingerprints,
        op6_source_mixing,
        op7_quality_classifier,
        op8_token_id_output,
        op9_line_dedup,
        op10_suffix_dedup,
        op11_embedding_whitening,
        op12_periodic_runs,
        op13_byte_bpe,
    )
}

ORACLE_SQL = {
    "op4_benchmark_decontamination": OP4_SQL,
    "op5_document_fingerprints": OP5_SQL,
    "op6_source_mixing": OP6_SQL,
    "op9_line_dedup": OP9_SQL,
}
