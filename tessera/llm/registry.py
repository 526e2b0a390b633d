"""Queries of this subpackage, and SQL for those that SQL can express."""

from tessera.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from tessera.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from tessera.llm.lattice_lm import op9_lattice_lm
from tessera.llm.line_dedup import op8_line_dedup
from tessera.llm.merkle import OP11_SQL, op11_merkle_manifest
from tessera.llm.mixing import op6_mixing
from tessera.llm.near_dedup import op7_near_dedup
from tessera.llm.packing import op10_packing
from tessera.llm.quality import op5_quality
from tessera.llm.secret_scan import op1_secret_scan
from tessera.llm.substring_dedup import op2_substring_dedup
from tessera.llm.toxicity import op12_toxicity
from tessera.llm.webp_lossless import op4_media_columns

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_media_columns": op4_media_columns,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_near_dedup": op7_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_lattice_lm": op9_lattice_lm,
    "op10_packing": op10_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_toxicity": op12_toxicity,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op11_merkle_manifest": OP11_SQL, "op13_hard_negatives": OP13_SQL}
