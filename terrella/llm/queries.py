"""Queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from terrella.llm import balltree, interleave, licenses, media, ngrams, packing, pieces, quality, simhash, substrings


def queries():
    return {
        "op1_sentencepiece": pieces.op1_sentencepiece,
        "op2_ball_tree": balltree.op2_ball_tree,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_simhash": simhash.op4_simhash,
        "op5_media_columns": media.op5_media_columns,
        "op6_best_two_fit": packing.op6_best_two_fit,
        "op7_substring_dedup": substrings.op7_substring_dedup,
        "op8_backoff_automaton": ngrams.op8_backoff_automaton,
        "op9_pu_quality": quality.op9_pu_quality,
        "op10_stratified_interleave": interleave.op10_stratified_interleave,
    }


def oracle_sql():
    return {"op2_ball_tree": balltree.OP2_SQL, "op3_license_scan": licenses.scan_sql()}
