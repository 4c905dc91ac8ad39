"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat, embedding_dedup, quality_rules
from .alignment import op13_token_alignment
from .centroids import op12_adaptive_clusters
from .chat import op5_chat_format
from .decontaminate import op8_template_matches
from .embedding_dedup import op6_rotated_code_links
from .language_id import op1_language_mixture
from .packing import op4_minimum_slack_packing
from .quality_rules import op11_host_rules
from .simhash import op10_simhash_components
from .token_counts import op3_length_histogram
from .token_output import op2_simple8b_tokens
from .toxicity import op9_lexicon_toxicity
from .url_filter import op7_link_trust

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_mixture,
        op2_simple8b_tokens,
        op3_length_histogram,
        op4_minimum_slack_packing,
        op5_chat_format,
        op6_rotated_code_links,
        op7_link_trust,
        op8_template_matches,
        op9_lexicon_toxicity,
        op10_simhash_components,
        op11_host_rules,
        op12_adaptive_clusters,
        op13_token_alignment,
    )
}

ORACLE_SQL: dict[str, str] = {
    op5_chat_format.__name__: chat.ORACLE,
    op6_rotated_code_links.__name__: embedding_dedup.ORACLE,
    op11_host_rules.__name__: quality_rules.ORACLE,
    op12_adaptive_clusters.__name__: centroids.ORACLE,
}
