"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from .bpe_tree import op9_bpe_tree
from .embedding_dedup import op7_embedding_dedup
from .ngram_join import op2_ngram_join
from .packing import op4_pack
from .quality_knn import op8_quality_knn
from .quality_rules import op10_quality_rules
from .substring_dedup import op5_substring_dedup
from .token_planes import op1_token_planes
from .toxicity import op6_toxicity
from .url_lists import OP3_SQL, op3_url_lists

QUERIES = {
    "op1_token_planes": op1_token_planes,
    "op2_ngram_join": op2_ngram_join,
    "op3_url_lists": op3_url_lists,
    "op4_pack": op4_pack,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_quality_knn": op8_quality_knn,
    "op9_bpe_tree": op9_bpe_tree,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES: dict[str, str] = {"op3_url_lists": OP3_SQL}
