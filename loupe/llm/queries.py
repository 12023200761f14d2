"""The registered queries of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("op1_shard", "op2_mix", "op3_decontaminate", "op4_suffix", "op5_near", "op6_substring", "op7_chat", "op8_tokens", "op9_warc", "op10_quality")

QUERIES: dict = {}
ORACLES: dict = {}

for _name in MODULES:
    _module = import_module(f"loupe.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
