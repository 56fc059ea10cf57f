"""The queries of this subpackage, and SQL where it can express one."""

from .bpe_codec import op7_bpe_codec
from .html_text import op5_html_text
from .language import op10_language_id
from .license_scan import op1_license_scan
from .matroska import op6_matroska
from .mixing import op3_mixing
from .pii import op2_pii
from .quality import OP8_SQL, op8_quality_rules
from .simhash_dedup import op4_simhash_dedup
from .token_count import op9_token_count

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_pii, op3_mixing, op4_simhash_dedup, op5_html_text, op6_matroska, op7_bpe_codec, op8_quality_rules, op9_token_count, op10_language_id)}

ORACLE_SQL = {"op8_quality_rules": OP8_SQL}
