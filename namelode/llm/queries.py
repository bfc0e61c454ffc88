"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from .op01_sharding import OP1_SQL, op1_query
from .op02_packing import op2_query
from .op03_licenses import op3_query
from .op04_jaccard import OP4_SQL, op4_query
from .op05_revisits import OP5_SQL, op5_query
from .op06_chains import op6_query
from .op07_toxicity import op7_query
from .op08_media import op8_query
from .op09_topk import OP9_SQL, op9_query
from .op10_pieces import op10_query
from .op11_variants import OP11_SQL, op11_query
from .op12_mixing import OP12_SQL, op12_query
from .op13_codes import OP13_SQL, op13_query

QUERIES = {
    "op1_stratified_shards": op1_query,
    "op2_cutting_stock": op2_query,
    "op3_license_notices": op3_query,
    "op4_jaccard_classes": op4_query,
    "op5_revisit_resolution": op5_query,
    "op6_collinear_chains": op6_query,
    "op7_noisy_channel": op7_query,
    "op8_media_archives": op8_query,
    "op9_maxscore_topk": op9_query,
    "op10_merge_pieces": op10_query,
    "op11_spelling_variants": op11_query,
    "op12_target_mix": op12_query,
    "op13_elkan_codes": op13_query,
}

ORACLES = {
    "op1_stratified_shards": OP1_SQL,
    "op4_jaccard_classes": OP4_SQL,
    "op5_revisit_resolution": OP5_SQL,
    "op9_maxscore_topk": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_target_mix": OP12_SQL,
    "op13_elkan_codes": OP13_SQL,
}
