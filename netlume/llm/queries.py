"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from .exact_dedup import OP3_SQL, op3_exact_dedup
from .katz import op6_katz
from .language_id import op7_language_id
from .packing import op9_packing
from .quality_classifier import op1_quality
from .quality_rules import op10_quality_rules
from .sentencepiece_codec import op2_sentencepiece
from .simhash import op8_simhash
from .substring_dedup import op4_substring_dedup
from .token_counts import op5_token_counts

QUERIES = {
    "op1_quality": op1_quality,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_katz": op6_katz,
    "op7_language_id": op7_language_id,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
}

ORACLES: dict[str, str] = {"op3_exact_dedup": OP3_SQL}
