"""Registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from tidemark.llm.centroids import OP13_SQL, op13_centroids
from tidemark.llm.chat_trees import OP8_SQL, op8_chat_trees
from tidemark.llm.compression_rules import op4_compression_rules
from tidemark.llm.decontaminate import op9_decontaminate
from tidemark.llm.kn_toxicity import op7_kn_toxicity
from tidemark.llm.lexicon_bpe import op5_lexicon_bpe
from tidemark.llm.quality_trees import op2_quality_trees
from tidemark.llm.simhash_ball import op6_simhash_ball
from tidemark.llm.source_divergence import OP11_SQL, op11_source_divergence
from tidemark.llm.span_dedup import OP3_SQL, op3_span_dedup
from tidemark.llm.suffix_dedup import OP10_SQL, op10_suffix_dedup
from tidemark.llm.token_counts import op1_token_counts
from tidemark.llm.warc_segments import OP12_SQL, op12_warc_segments

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_quality_trees, op3_span_dedup, op4_compression_rules, op5_lexicon_bpe, op6_simhash_ball,
        op7_kn_toxicity, op8_chat_trees, op9_decontaminate, op10_suffix_dedup,
        op11_source_divergence, op12_warc_segments, op13_centroids,
    )
}
SQL = {
    "op3_span_dedup": OP3_SQL, "op8_chat_trees": OP8_SQL, "op10_suffix_dedup": OP10_SQL, "op11_source_divergence": OP11_SQL, "op12_warc_segments": OP12_SQL,
    "op13_centroids": OP13_SQL,
}
