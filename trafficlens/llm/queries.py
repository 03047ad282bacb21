"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .embed_dedup import OP8_SQL, op8_embedding_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .language import op5_language_id
from .line_dedup import op6_line_dedup
from .mixing import OP9_SQL, op9_mixing
from .ngram_join import op2_ngram_join
from .packing import op10_packing
from .quality import op1_quality
from .token_counts import op13_token_counts
from .tool_calls import OP7_SQL, op7_tool_calls
from .topk import OP3_SQL, op3_exact_topk
from .url_filter import OP4_SQL, op4_url_filter
from .whitening import op12_whitening

QUERIES = {
    "op1_quality": op1_quality,
    "op2_ngram_join": op2_ngram_join,
    "op3_exact_topk": op3_exact_topk,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_tool_calls": op7_tool_calls,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_token_counts": op13_token_counts,
}
ORACLES = {"op11_hard_negatives": OP11_SQL, "op7_tool_calls": OP7_SQL, "op3_exact_topk": OP3_SQL, "op4_url_filter": OP4_SQL, "op8_embedding_dedup": OP8_SQL, "op9_mixing": OP9_SQL}
