"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, language, media, ngram_join, packing, privacy, quality, repeats, sql, tokens

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_media": media.op2_media,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_packing": packing.op4_packing,
    "op5_pii": privacy.op5_pii,
    "op6_language": language.op6_language,
    "op6_pages": language.op6_pages,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_repeats": repeats.op8_repeats,
    "op9_bpe": tokens.op9_bpe,
    "op10_token_counts": tokens.op10_token_counts,
}

ORACLES = {"op3_ngram_join": sql.OP3, "op7_exact_dedup": exact_dedup.OP7_SQL, "op8_repeats": sql.OP8}
