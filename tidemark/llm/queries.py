"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, language_model, line_dedup, mixing, pii, quality_model, quality_rules, simhash, toxicity, url_filter
from .common import table


def queries() -> dict:
    docs = lambda s, d: table(s, d, "documents")
    labels = lambda s, d: table(s, d, "labels")
    return {
        "op1_simhash": lambda s, d: simhash.op1_simhash(docs(s, d)),
        "op2_url_filter": lambda s, d: url_filter.op2_url_filter(table(s, d, "pages")),
        "op3_quality_rules": lambda s, d: quality_rules.op3_quality_rules(docs(s, d)),
        "op4_pii": lambda s, d: pii.op4_pii(docs(s, d)),
        "op5_mix": lambda s, d: mixing.op5_mix(docs(s, d)),
        "op6_decontaminate": lambda s, d: decontaminate.op6_decontaminate(docs(s, d), table(s, d, "benchmark")),
        "op7_line_dedup": lambda s, d: line_dedup.op7_line_dedup(docs(s, d)),
        "op8_toxicity": lambda s, d: toxicity.op8_toxicity(docs(s, d), labels(s, d)),
        "op9_quality_classifier": lambda s, d: quality_model.op9_quality_classifier(docs(s, d), labels(s, d)),
        "op10_language_model": lambda s, d: language_model.op10_language_model(docs(s, d)),
    }


def oracle_sql() -> dict:
    return {"op2_url_filter": url_filter.SQL, "op5_mix": mixing.SQL, "op6_decontaminate": decontaminate.SQL, "op7_line_dedup": line_dedup.SQL}
