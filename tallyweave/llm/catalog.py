"""Queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import crf, decontaminate, fm, jaccard, mixing, quality, secrets, urlfilter, warc, wrapper
from .oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        wrapper.op1_html_extraction,
        mixing.op2_mixing,
        urlfilter.op3_url_filters,
        decontaminate.op4_decontamination,
        quality.op5_quality_rules,
        fm.op6_quality_classifier,
        crf.op7_language_id,
        jaccard.op8_ngram_jaccard,
        secrets.op9_secret_scans,
        warc.op10_warc,
    )
}
