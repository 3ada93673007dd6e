"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from retentio.llm import (centroids, decontaminate, fingerprints, hard_negatives, html_extract, importance, jaccard_join,
                          line_dedup, packing, secrets, suffix_dedup, toxicity, url_filter)

QUERIES = {f.__name__: f for f in (
    secrets.op1_secret_scan,
    suffix_dedup.op2_suffix_dedup,
    fingerprints.op3_fingerprints,
    importance.op4_importance,
    line_dedup.op5_line_dedup,
    toxicity.op6_toxicity,
    decontaminate.op7_decontaminate,
    jaccard_join.op8_jaccard_join,
    url_filter.op9_url_filter,
    packing.op10_packing,
    html_extract.op11_html,
    centroids.op12_centroids,
    hard_negatives.op13_hard_negatives,
)}

ORACLE = {
    "op5_line_dedup": line_dedup.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op12_centroids": centroids.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
