"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftlog.llm import oracles
from driftlog.llm.best_fit_packing import op5_best_fit_packing
from driftlog.llm.decontamination import op1_decontamination
from driftlog.llm.html_wrappers import op2_html_wrappers
from driftlog.llm.near_dedup import op8_near_dedup
from driftlog.llm.pii import op4_pii
from driftlog.llm.quality_classifier import op7_quality_classifier
from driftlog.llm.quality_rules import op3_quality_rules
from driftlog.llm.secret_scan import op6_secret_scan
from driftlog.llm.token_counts import op10_token_counts
from driftlog.llm.toxicity import op9_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_html_wrappers": op2_html_wrappers,
        "op3_quality_rules": op3_quality_rules,
        "op4_pii": op4_pii,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_secret_scan": op6_secret_scan,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_near_dedup": op8_near_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
