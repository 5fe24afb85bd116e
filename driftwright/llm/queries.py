"""Registry of the subpackage's queries and, where SQL can express one, its oracle."""

from __future__ import annotations

from .chat_format import op10_chat_format
from .mixing import ORACLE as MIXING_SQL
from .mixing import op3_source_mixing
from .near_duplicates import op7_near_duplicates
from .oracles import ORACLES as CONTRACTS
from .phrase_fingerprints import op8_phrase_fingerprints
from .piece_encoding import op2_piece_encoding
from .quality_rules import op9_quality_rules
from .secret_scan import op4_secret_scan
from .sharding import op5_sharding
from .toxicity import op6_toxicity
from .token_counts import op1_token_counts

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_piece_encoding, op3_source_mixing, op4_secret_scan, op6_toxicity, op7_near_duplicates, op8_phrase_fingerprints, op5_sharding, op9_quality_rules, op10_chat_format)}

ORACLES: dict[str, str] = CONTRACTS | {"op3_source_mixing": MIXING_SQL}
