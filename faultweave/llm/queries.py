"""The llm queries and their SQL, as the driver's entry point registers them."""

from __future__ import annotations

import importlib

#: name -> (module, function)
_QUERIES = {
    "op1_lm_scores": ("faultweave.llm.scoring", "op1_lm_scores"),
    "op2_fingerprints": ("faultweave.llm.sketches", "op2_fingerprints"),
    "op3_private": ("faultweave.llm.private", "op3_private"),
    "op4_packing": ("faultweave.llm.packing", "op4_packing"),
    "op5_shards": ("faultweave.llm.shards", "op5_shards"),
    "op6_similar": ("faultweave.llm.similar", "op6_similar"),
    "op7_languages": ("faultweave.llm.languages", "op7_languages"),
    "op9_pages": ("faultweave.llm.pages", "op9_pages"),
    "op8_repeats": ("faultweave.llm.repeats", "op8_repeats"),
    "op10_leaks": ("faultweave.llm.leaks", "op10_leaks"),
}
#: name -> (module, constant)
_SQL = {
    "op1_lm_scores": ("faultweave.llm.scoring", "OP1_SQL"),
    "op6_similar": ("faultweave.llm.similar", "OP6_SQL"),
    "op8_repeats": ("faultweave.llm.repeats", "OP8_SQL"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(module), fn) for name, (module, fn) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(module), sql) for name, (module, sql) in _SQL.items()}
