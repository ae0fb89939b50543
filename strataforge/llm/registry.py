"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import document_sql, embedding_dedup, vector_codes, warc
from .bpe import op10_byte_bpe
from .embedding_dedup import op3_embedding_cells
from .language_id import op12_string_kernel
from .license_scan import op8_licence_classifier
from .near_dup import op2_minhash_forest
from .packing import op5_best_fit
from .quality import op4_quality_rules
from .secret_scan import op6_secret_index
from .suffix_dedup import op7_suffix_array
from .token_rollup import op9_token_rollup
from .turn_repair import op11_turn_repair
from .vector_codes import op13_grid_codes
from .warc import op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_minhash_forest": op2_minhash_forest,
    "op3_embedding_cells": op3_embedding_cells,
    "op4_quality_rules": op4_quality_rules,
    "op5_best_fit": op5_best_fit,
    "op6_secret_index": op6_secret_index,
    "op7_suffix_array": op7_suffix_array,
    "op8_licence_classifier": op8_licence_classifier,
    "op9_token_rollup": op9_token_rollup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_turn_repair": op11_turn_repair,
    "op12_string_kernel": op12_string_kernel,
    "op13_grid_codes": op13_grid_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op2_minhash_forest": document_sql.NEAR,
    "op3_embedding_cells": embedding_dedup.ORACLE,
    "op6_secret_index": document_sql.SECRETS,
    "op7_suffix_array": document_sql.REPEATS,
    "op13_grid_codes": vector_codes.ORACLE,
}
