"""Operators for preparing training text at scale, one module per operator.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()`` list the registered queries.
"""

from __future__ import annotations

import importlib

#: Module of each operator; its registered query carries the same name.
MODULES = (
    "op1_quality_forest",
    "op2_language_id",
    "op3_decontaminate",
    "op4_ppm_score",
    "op5_token_files",
    "op6_best_fit_packing",
    "op7_line_dedup",
    "op8_jaccard_join",
    "op9_token_counts",
    "op10_secret_spans",
    "op11_periodic_runs",
    "op12_license_scan",
    "op13_phrase_mining",
)


def queries():
    return {name: importlib.import_module(f"{__name__}.{name}").query for name in MODULES}


def oracle_sql():
    found = {name: getattr(importlib.import_module(f"{__name__}.{name}"), "ORACLE_SQL", None) for name in MODULES}
    return {name: sql for name, sql in found.items() if sql}
