"""Operators for the preparation of training text; nothing else in the library imports them."""

from fleetsight.llm import (  # noqa: F401
    bwt_dedup, collocations, decontamination, html_text, near_dedup, packing, passage_quality, personal_data, quality_rules,
    secret_scan, spelling, substring_dedup, toxicity)
from fleetsight.llm.frames import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
