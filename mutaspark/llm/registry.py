"""The queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from .clustering import OP13_SQL, op13_centroids
from .embedding_dedup import op6_embedding_dedup
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .hilbert import op4_hilbert_shards
from .html_text import op1_html_text
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import OP3_SQL, op3_pareto_mix
from .near_dedup import op2_near_dedup
from .packing import op8_mixture_packing
from .quality import op9_quality
from .secrets import op10_secrets
from .suffixes import op7_repeated_passages
from .toxicity import op11_toxicity

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_near_dedup": op2_near_dedup,
    "op3_pareto_mix": op3_pareto_mix,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_mixture_packing": op8_mixture_packing,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
    "op11_toxicity": op11_toxicity,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_centroids": op13_centroids,
}
ORACLES = {"op3_pareto_mix": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op12_merkle_manifest": OP12_SQL, "op13_centroids": OP13_SQL}
