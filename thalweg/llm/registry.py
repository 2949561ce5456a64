"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Query -> (module, function, whether the module has its DuckDB SQL as ORACLE_SQL).
QUERIES = {
    "op1_suffix_dedup": ("thalweg.llm.suffix_dedup", "op1_suffix_dedup", False),
    "op2_pii": ("thalweg.llm.pii", "op2_pii", False),
    "op3_secrets": ("thalweg.llm.secrets", "op3_secrets", False),
    "op4_simhash": ("thalweg.llm.simhash", "op4_simhash", False),
    "op5_mixing": ("thalweg.llm.mixing", "op5_mixing", True),
    "op6_fm_dedup": ("thalweg.llm.fm_dedup", "op6_fm_dedup", False),
    "op7_bpe": ("thalweg.llm.bpe", "op7_bpe", False),
    "op8_mpeg": ("thalweg.llm.mpeg", "op8_mpeg", False),
    "op9_quality": ("thalweg.llm.quality", "op9_quality", False),
    "op10_line_rules": ("thalweg.llm.line_rules", "op10_line_rules", False),
    "op11_importance": ("thalweg.llm.importance", "op11_importance", True),
    "op12_fim": ("thalweg.llm.fim", "op12_fim", True),
    "op13_decontamination": ("thalweg.llm.decontamination", "op13_decontamination", True),
    "pipeline": ("corpus_pipeline", "run", False),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(module), f) for name, (module, f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: importlib.import_module(module).ORACLE_SQL for name, (module, _, has) in QUERIES.items() if has}
