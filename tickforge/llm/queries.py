"""Queries of the operators in this package, and SQL for those that it can express."""

import corpus_pipeline

from .alignment import op12_alignment
from .chat import op2_chat
from .decontaminate import OP10_SQL, op10_decontamination
from .language import op9_language
from .lexical import OP11_SQL, op11_lexical
from .licenses import OP8_SQL, op8_licenses
from .neighbours import OP6_SQL, op6_neighbours
from .packing import op3_packing
from .pitman_yor import op1_pitman_yor
from .pivots import OP13_SQL, op13_pivots
from .sharding import OP7_SQL, op7_sharding
from .simhash import op4_simhash
from .substring import OP5_SQL, op5_substring

QUERIES = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_chat": op2_chat,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_substring": op5_substring,
    "op6_neighbours": op6_neighbours,
    "op7_sharding": op7_sharding,
    "op8_licenses": op8_licenses,
    "op9_language": op9_language,
    "op10_decontamination": op10_decontamination,
    "op11_lexical": op11_lexical,
    "op12_alignment": op12_alignment,
    "op13_pivots": op13_pivots,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op5_substring": OP5_SQL,
    "op7_sharding": OP7_SQL,
    "op8_licenses": OP8_SQL,
    "op6_neighbours": OP6_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_lexical": OP11_SQL,
    "op13_pivots": OP13_SQL,
}
