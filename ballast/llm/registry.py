"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from ballast.llm import centroids, decontam, html_text, huffman, line_index, mixing, neardup, quality, secrets, sharding, substrings, vector_codes, warc


def queries() -> dict:
    return {
        "op1_quality_divergence": quality.op1,
        "op2_neardup_bottom_k": neardup.op2,
        "op3_html_line_blocks": html_text.op3,
        "op4_token_ids_huffman": huffman.op4,
        "op5_decontam_fm_index": decontam.op5,
        "op6_secrets_automaton": secrets.op6,
        "op7_mixing_temperature": mixing.op7,
        "op8_substrings_prefix_doubling": substrings.op8,
        "op9_sharding_minimax": sharding.op9,
        "op10_warc_shards": warc.op10,
        "op11_clusters_exponion": centroids.op11,
        "op12_codes_kd_trees": vector_codes.op12,
        "op13_lines_perfect_hash": line_index.op13,
    }


def oracle_sql() -> dict:
    return {
        "op1_quality_divergence": quality.SQL,
        "op7_mixing_temperature": mixing.SQL,
        "op10_warc_shards": warc.SQL,
        "op11_clusters_exponion": centroids.SQL,
        "op12_codes_kd_trees": vector_codes.SQL,
        "op13_lines_perfect_hash": line_index.SQL,
    }
