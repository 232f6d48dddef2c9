"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from vecspark.llm import decontaminate, line_dedup, lm_score, packing, simhash, site_tree, topk, toxicity, url_filter, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_warc": warc.op3_warc,
    "op4_main_text": site_tree.op4_main_text,
    "op5_simhash": simhash.op5_simhash,
    "op6_pack": packing.op6_pack,
    "op7_topk": topk.op7_topk,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_lm_score": lm_score.op9_lm_score,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op7_topk": topk.OP7_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
}
