"""All queries of this subpackage."""

import importlib

_MODULES = ("q_bpe", "q_quality", "q_toxicity", "q_sharding", "q_license", "q_jaccard", "q_neardup", "q_decontam", "q_html", "q_lm", "q_audit", "q_align", "q_secret")
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in _MODULES:
    _module = importlib.import_module(f"inkwell.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
