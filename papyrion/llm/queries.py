"""The subpackage's named queries and, where SQL can express them, their DuckDB form."""

from __future__ import annotations

from papyrion.llm import abuse, body, bpe, copies, lookalikes, packing, pieces, residue, sitelines

QUERIES = {
    "p1_found": lookalikes.p1_found,
    "p1_classes": lookalikes.p1_classes,
    "p1_forms": lookalikes.p1_forms,
    "p2_found": copies.p2_found,
    "p2_groups": copies.p2_groups,
    "p2_layouts": copies.p2_layouts,
    "p3_found": body.p3_found,
    "p3_bodies": body.p3_bodies,
    "p5_found": pieces.p5_found,
    "p5_pieces": pieces.p5_pieces,
    "p5_checks": pieces.p5_checks,
    "p6_found": residue.p6_found,
    "p6_cases": residue.p6_cases,
    "p7_found": sitelines.p7_found,
    "p7_clean": sitelines.p7_clean,
    "p8_ids": bpe.p8_ids,
    "p9_containers": packing.p9_containers,
    "p9_checks": packing.p9_checks,
    "p10_found": abuse.p10_found,
    "p10_scores": abuse.p10_scores,
    "p10_rates": abuse.p10_rates,
}
SQL = {
    "p2_layouts": copies.P2_LAYOUTS_SQL,
    "p5_found": pieces.P5_SQL,
    "p5_checks": pieces.P5_CHECKS_SQL,
    "p7_found": sitelines.P7_SQL,
    "p7_clean": sitelines.P7_CLEAN_SQL,
    "p9_checks": packing.P9_CHECKS_SQL,
}
