"""The queries of this subpackage by name, with their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op9_bpe
from .embedding_dedup import OP10_SQL, op10_embedding_dedup
from .html_extract import op5_html_text
from .jaccard_join import OP8_SQL, op8_jaccard_join
from .mixing import OP13_SQL, op13_mixing
from .packing import op4_packing
from .ranked_search import OP11_SQL, op11_search
from .sharding import OP2_SQL, op2_sharding
from .spelling import OP12_SQL, op12_spelling
from .suffix_dedup import op1_suffix_dedup
from .token_counts import op6_token_counts
from .topk_search import OP7_SQL, op7_topk
from .toxicity import op3_toxicity

QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_sharding": op2_sharding, "op3_toxicity": op3_toxicity, "op4_packing": op4_packing, "op5_html_text": op5_html_text, "op6_token_counts": op6_token_counts, "op7_topk": op7_topk, "op8_jaccard_join": op8_jaccard_join, "op9_bpe": op9_bpe, "op10_embedding_dedup": op10_embedding_dedup, "op11_search": op11_search, "op12_spelling": op12_spelling, "op13_mixing": op13_mixing}
ORACLE_SQL: dict[str, str] = {"op2_sharding": OP2_SQL, "op7_topk": OP7_SQL, "op8_jaccard_join": OP8_SQL, "op10_embedding_dedup": OP10_SQL, "op11_search": OP11_SQL, "op12_spelling": OP12_SQL, "op13_mixing": OP13_SQL}
