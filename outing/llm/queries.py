"""The queries and SQL of this subpackage, for the driver's contract."""

from __future__ import annotations

from outing.llm import centroid_clustering, collocations
from outing.llm.centroid_clustering import op11_centroid_clustering
from outing.llm.collocations import op13_collocations
from outing.llm.decontamination import op5_benchmark_decontamination
from outing.llm.embedding_dedup import op2_embedding_near_dedup
from outing.llm.language_id import op6_language_id
from outing.llm.line_dedup import op7_line_dedup
from outing.llm.minhash_dedup import op8_minhash_near_dedup
from outing.llm.packing import op1_best_fit_packing
from outing.llm.quality import op3_quality_classifier
from outing.llm.secrets import op10_secret_scan
from outing.llm.token_counts import op9_token_counts
from outing.llm.token_output import op12_token_output
from outing.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_toxicity": op4_toxicity,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_secret_scan": op10_secret_scan,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_token_output": op12_token_output,
    "op13_collocations": op13_collocations,
}

#: DuckDB SQL where it can state an operator on whole tables. The rest is beyond it or too slow there: tokenizers,
#: trained models, random projections, character offsets and all pairs.
ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clustering": centroid_clustering.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
