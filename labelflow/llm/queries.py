"""The operators' queries, and DuckDB twins where SQL can express them."""

from .bpe import op3_bpe
from .fillmiddle import FILL_MIDDLE_SQL, op12_fill_middle
from .lexical import RANKING_SQL, op11_ranking
from .packing import op5_packing
from .pages import op10_html
from .pii import op4_pii
from .ppm import op6_lm_scoring
from .quality import op9_quality
from .search import TOPK_SQL, op8_topk
from .sharding import op1_shards
from .simhash import op7_simhash
from .substring import SUBSTRING_SQL, op2_substring
from .urls import URLS_SQL, op13_urls

QUERIES = {
    "op1_shards": op1_shards,
    "op2_substring": op2_substring,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_simhash": op7_simhash,
    "op8_topk": op8_topk,
    "op9_quality": op9_quality,
    "op10_html": op10_html,
    "op11_ranking": op11_ranking,
    "op12_fill_middle": op12_fill_middle,
    "op13_urls": op13_urls,
}

ORACLE: dict[str, str] = {
    "op2_substring": SUBSTRING_SQL,
    "op8_topk": TOPK_SQL,
    "op11_ranking": RANKING_SQL,
    "op12_fill_middle": FILL_MIDDLE_SQL,
    "op13_urls": URLS_SQL,
}
