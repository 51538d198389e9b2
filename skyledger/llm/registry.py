"""Queries of the training-data operators, by name, and SQL for those that SQL can express."""

from . import contextmix, htmltext, linedup, media, mixing, neardup, packing, pieces, quality, toxicity, urlfilter, whitening

QUERIES = {
    "op1_main_text": htmltext.op1,
    "op2_media_columns": media.op2,
    "op3_toxicity": toxicity.op3,
    "op4_mix_sources": mixing.op4,
    "op5_quality_ratio": quality.op5,
    "op6_near_duplicates": neardup.op6,
    "op7_best_fit_packing": packing.op7,
    "op8_line_dedup": linedup.op8,
    "op9_url_filters": urlfilter.op9,
    "op10_context_mixing": contextmix.op10,
    "op11_pieces": pieces.op11,
    "op12_whitening": whitening.op12,
}
ORACLES = {"op4_mix_sources": mixing.OP4_SQL, "op9_url_filters": urlfilter.OP9_SQL}
