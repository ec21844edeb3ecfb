"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from memoglyph.llm import bpe, clusters, html_text, langid, mixing, near_dedup, packing, quality, sharding, toxicity, trie, vectors

QUERIES = {
    "op1_ann": vectors.op1_ann,
    "op2_topk": vectors.op2_topk,
    "op3_bpe": bpe.op3_bpe,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_quality": quality.op5_quality,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mixing": mixing.op7_mixing,
    "op8_sharding": sharding.op8_sharding,
    "op9_language_id": langid.op9_language_id,
    "op10_html": html_text.op10_html,
    "op11_trie": trie.op11_trie,
    "op12_clusters": clusters.op12_clusters,
    "op13_packing": packing.op13_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op2_topk": vectors.OP2_SQL,
    "op4_near_dedup": near_dedup.OP4_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op11_trie": trie.ORACLE_SQL,
    "op12_clusters": clusters.ORACLE_SQL,
}
