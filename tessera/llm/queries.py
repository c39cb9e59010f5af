"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .blocklabel import op12_main_text
from .bpe import op2_bpe_encode
from .divergence import OP11_SQL, op11_source_divergence
from .feistel import op7_training_order
from .filteraudit import OP13_SQL, op13_filter_audit
from .jaccard import op4_jaccard_join
from .langid import op3_language_id
from .linededup import OP10_SQL, op10_line_dedup
from .mixing import OP1_SQL, op1_mix_sources
from .multiindex import op5_nearest
from .quality import op6_quality
from .suffix import op8_suffix_dedup
from .webp import op9_media


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_bpe_encode": op2_bpe_encode,
        "op3_language_id": op3_language_id,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_nearest": op5_nearest,
        "op6_quality": op6_quality,
        "op7_training_order": op7_training_order,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_media": op9_media,
        "op10_line_dedup": op10_line_dedup,
        "op11_source_divergence": op11_source_divergence,
        "op12_main_text": op12_main_text,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": OP1_SQL,
        "op10_line_dedup": OP10_SQL,
        "op11_source_divergence": OP11_SQL,
        "op13_filter_audit": OP13_SQL,
    }
