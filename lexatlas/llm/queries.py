"""The queries of the subpackage for training data."""

from __future__ import annotations

from lexatlas.llm import cooccurrence, frequency, groups, harmful, language, mixing, names, tokens
from lexatlas.llm.sql import SQL


def queries() -> dict:
    return {
        "p1_found": cooccurrence.p1_found,
        "p1_pairs": cooccurrence.p1_pairs,
        "p2_found": frequency.p2_found,
        "p2_terms": frequency.p2_terms,
        "p3_found": groups.p3_found,
        "p5_found": names.p5_found,
        "p6_found": language.p6_found,
        "p6_segments": language.p6_segments,
        "p6_parts": language.p6_parts,
        "p7_ids": tokens.p7_ids,
        "p8_found": mixing.p8_found,
        "p8_shares": mixing.p8_shares,
        "p8_mix": mixing.p8_mix,
        "p9_found": harmful.p9_found,
        "p9_scores": harmful.p9_scores,
        "p9_rates": harmful.p9_rates,
    }


def sql() -> dict[str, str]:
    return dict(SQL)
