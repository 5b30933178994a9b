"""Queries of this subpackage and the SQL that says the same."""

from . import bitsliced, bpe_automaton, fertility, html_cut, huffman, line_dedup, mixing, near_dedup, secrets, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_huffman": huffman.op2_huffman,
    "op3_fertility": fertility.op3_fertility,
    "op4_main_text": html_cut.op4_main_text,
    "op5_secrets": secrets.op5_secrets,
    "op6_topk": bitsliced.op6_topk,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_bpe_automaton": bpe_automaton.op8_bpe_automaton,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES = {"op6_topk": bitsliced.SQL, "op5_secrets": secrets.SQL, "op7_line_dedup": line_dedup.SQL}
