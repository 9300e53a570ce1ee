"""Imports every query module so that its queries are registered."""

import importlib

from evalweave.plans.registry import ORACLES, QUERIES

MODULES = ["q_decontam", "q_curate", "q_requests", "q_score", "q_metrics", "q_analytics", "q_rules", "q_sources", "q_streaming"]
for _name in MODULES:
    importlib.import_module(f"evalweave.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
