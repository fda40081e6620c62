"""Queries of this subpackage: name -> callable (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from .chunks import op7_gear_chunks
from .decontam import op3_template_decontamination
from .html_text import op6_mincut_main_text
from .isomedia import op4_iso_media
from .neardup import op2_icws_near_duplicates
from .pieces import op5_gumbel_segmentations
from .prefix_trie import op12_burst_trie
from .quality import op9_quality
from .rans import op1_rans_token_blocks
from .repair import op11_bidirectional_repair
from .sharding import op8_balanced_shards
from .token_counts import op13_rank_synchronous_counts
from .toxicity import op10_toxicity

_ALL = [
    op1_rans_token_blocks, op2_icws_near_duplicates, op3_template_decontamination, op4_iso_media, op5_gumbel_segmentations,
    op6_mincut_main_text, op7_gear_chunks, op8_balanced_shards, op9_quality, op10_toxicity,
    op11_bidirectional_repair, op12_burst_trie, op13_rank_synchronous_counts,
]
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {}
