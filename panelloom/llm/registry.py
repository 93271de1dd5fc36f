"""The subpackage's queries and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from .chat_format import OP12_SQL, op12_chat_format
from .decontaminate import OP2_SQL, op2_benchmark_decontamination
from .divergence import OP13_SQL, op13_source_divergence
from .html_text import op6_main_text
from .langid import op1_language_mixture
from .pii import op10_personal_data
from .quality import op9_rule_ensemble
from .simhash import op3_simhash_near_dedup
from .telephony import op5_telephony_audio
from .token_file import op4_token_file
from .transducer import op7_piece_transducer
from .url_rules import OP8_SQL, op8_url_rules
from .vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_language_mixture": op1_language_mixture,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_token_file": op4_token_file,
    "op5_telephony_audio": op5_telephony_audio,
    "op6_main_text": op6_main_text,
    "op7_piece_transducer": op7_piece_transducer,
    "op8_url_rules": op8_url_rules,
    "op9_rule_ensemble": op9_rule_ensemble,
    "op10_personal_data": op10_personal_data,
    "op11_vector_codes": op11_vector_codes,
    "op12_chat_format": op12_chat_format,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": OP2_SQL,
    "op8_url_rules": OP8_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_chat_format": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
