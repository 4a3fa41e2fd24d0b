"""The queries of this subpackage, and their SQL where SQL can express them."""

from .byte_bpe import op6_byte_bpe
from .collocations import OP13_SQL, op13_collocations
from .fingerprints import op12_fingerprints
from .gif_media import op1_gif_media
from .language_id import op5_language_id
from .mixing import op3_mixing
from .near_dedup import OP10_SQL, op10_near_dedup
from .quality_classifier import op7_quality_classifier
from .quality_rules import OP8_SQL, op8_quality_rules
from .secret_scan import OP9_SQL, op9_secret_scan
from .spelling import OP11_SQL, op11_spelling
from .suffix_dedup import OP2_SQL, op2_suffix_dedup
from .token_counts import op4_token_counts


def queries() -> dict:
    return {f.__name__: f for f in (op1_gif_media, op2_suffix_dedup, op3_mixing, op4_token_counts, op5_language_id, op6_byte_bpe, op7_quality_classifier, op8_quality_rules, op9_secret_scan, op10_near_dedup, op11_spelling, op12_fingerprints, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op8_quality_rules": OP8_SQL, "op9_secret_scan": OP9_SQL, "op10_near_dedup": OP10_SQL, "op11_spelling": OP11_SQL, "op13_collocations": OP13_SQL}
