"""The registered queries of this subpackage and their SQL."""

from . import balls, chat, html, jaccard, media, mixing, packing, quality, repair, suffix, token_counts, topk, toxicity

QUERIES = {
    "op1_media_png": media.op1_media_png,
    "op2_top_inner_products": topk.op2_top_inner_products,
    "op3_suffix_dedup": suffix.op3_suffix_dedup,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_jaccard_components": jaccard.op5_jaccard_components,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_main_text": html.op7_main_text,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality": quality.op9_quality,
    "op10_pack_best_fit": packing.op10_pack_best_fit,
    "op11_chat_masks": chat.op11_chat_masks,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_ball_tree_clusters": balls.op13_ball_tree_clusters,
}

ORACLES = {
    "op2_top_inner_products": topk.ORACLE_SQL,
    "op6_mix_sources": mixing.ORACLE_SQL,
    "op11_chat_masks": chat.ORACLE_SQL,
    "op13_ball_tree_clusters": balls.ORACLE_SQL,
}
